"""Model-backed enrichment: prompts, batching, calls, responses, acceptance rules."""
