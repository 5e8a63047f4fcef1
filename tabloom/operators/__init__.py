"""Table operators: columns, routing, joins, grouping, sampling, views."""
