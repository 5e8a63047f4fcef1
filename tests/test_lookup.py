import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import tabloom.session as session
from tabloom.lookup import dictionary, fuzzy, places, substrings
from tabloom.lookup.dictionary import lookup
from tabloom.lookup.headings import subject_headings
from tabloom.lookup.tables import as_dictionary, dictionary_counts, register_dictionary


def values(df, column, order="i"):
    return [r[column] for r in df.orderBy(order).collect()]


@pytest.fixture
def never_small(monkeypatch):
    """Pretend every dictionary is above the broadcast bound."""
    from tabloom.lookup import tables

    monkeypatch.setattr(dictionary, "ordered_pairs", lambda d: None)
    monkeypatch.setattr(places, "ordered_pairs", lambda d: None)
    monkeypatch.setattr(dictionary, "broadcast_if_small", lambda d: d)
    return tables


def test_exact_folding(table):
    df = table("i int, s string", [(1, "PARIS"), (2, None), (3, "x"), (4, "rome")])
    d = table("key string, value string, ord int", [("Paris", "1", 0), ("paris", "2", 1), ("", "blank", 2), ("Rome", "", 3)])
    assert values(lookup(df, d, "s", "o", no_match_value="-"), "o") == ["2", "blank", "-", "-"]
    assert values(lookup(df, d, "s", "o", case_sensitive=True), "o") == ["", "blank", "", ""]
    with pytest.raises(ValueError):
        lookup(df, d, "s", "o", "like")
    with pytest.raises(ValueError):
        lookup(df, "no such table", "s", "o")


def brute_contains(text, pairs):
    return next((v for k, v in pairs if k in text), "none")


def random_case(seed, n_keys):
    random.seed(seed)
    letters = "abcé "
    keys = list(dict.fromkeys("".join(random.choices(letters, k=random.randint(1, 9))) for _ in range(n_keys)))
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(80)]
    return [(k, f"v{i}") for i, k in enumerate(keys)], texts


@pytest.mark.parametrize("n_keys", [20, 200])
def test_contains_all_ways(spark, monkeypatch, n_keys):
    pairs, texts = random_case(n_keys, n_keys)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    d = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, ord int")
    want = [brute_contains(t, pairs) for t in texts]
    assert values(lookup(df, d, "s", "o", "contains", no_match_value="none"), "o") == want
    monkeypatch.setattr(dictionary, "ordered_pairs", lambda x: None)
    assert values(lookup(df, d, "s", "o", "contains", no_match_value="none"), "o") == want
    extra = d.unionAll(spark.createDataFrame([("", "always", 10)], "key string, value string, ord int"))
    first = [min([(i, v) for i, (k, v) in enumerate(pairs) if k in t] + [(10, "always")])[1] for t in texts]
    assert values(lookup(df, extra, "s", "o", "contains"), "o") == first


def test_hits_with_long_keys(spark):
    texts = spark.createDataFrame([("the quick brown fox",), ("quick",), ("",)], "text string")
    keys = spark.createDataFrame([("quick brown", "a", 0), ("quick", "b", 1), ("zzz", "c", 2), ("q", "d", 3)],
                                 "key string, value string, ord int")
    got = sorted((r.digest, r.key) for r in substrings.hits(texts, keys).collect())
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == sorted([(md5("the quick brown fox"), k) for k in ("quick brown", "quick", "q")]
                         + [(md5("quick"), k) for k in ("quick", "q")])
    assert substrings.hits(texts, keys.limit(0)).count() == 0


def test_fuzzy_queries_over_real_names_match_difflib(spark):
    import __spark_entry__ as contract

    folder, queries = "/root/testdata/sf0.001", contract.queries()

    def rows(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]

    def brute(text, keys):
        best, found = 0.7, None
        for key, value in keys:
            ratio = SequenceMatcher(None, text, key).ratio()
            if ratio > best:
                best, found = ratio, value
        return found

    first = {}
    for name, i in sorted(rows("part", "p_name", "p_partkey"), key=lambda r: r[1]):
        first.setdefault(name.lower(), name)
    got = queries["lookup_fuzzy_names"](spark, folder).collect()
    assert len(got) == len(rows("part", "p_partkey")) and len({r.typo for r in got}) > 100
    known = {t: brute(t.lower(), list(first.items())) or "" for t in {r.typo for r in got}}
    assert {(r.p_partkey, r.found) for r in got} == {(r.p_partkey, known[r.typo]) for r in got}
    keys = [(n.lower(), str(i)) for n, i in sorted(rows("supplier", "s_name", "s_suppkey"), key=lambda r: r[1])]
    want = {n.lower(): brute(n.lower(), keys) for (n,) in rows("customer", "c_name")}
    got = {r.text: r.value for r in queries["lookup_fuzzy_names_blocks"](spark, folder).collect()}
    assert got == {t: v for t, v in want.items() if v is not None}


def test_fuzzy_matches_difflib(spark, monkeypatch):
    random.seed(3)
    keys = [f"nation {i} {random.choice(['north', 'south'])}" for i in range(40)]
    texts = [k.replace(random.choice(k), random.choice("xyz"), 1) for k in keys] + ["", "zzz", "nation"]

    def brute(text):
        best, found = 0.7, ""
        for i, key in enumerate(keys):
            ratio = SequenceMatcher(None, text, key).ratio()
            if ratio > best:
                best, found = ratio, f"v{i}"
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    d = spark.createDataFrame([(k, f"v{i}", i) for i, k in enumerate(keys)], "key string, value string, ord int")
    want = [brute(t) for t in texts]
    assert values(lookup(df, d, "s", "o", "fuzzy"), "o") == want
    blocks = fuzzy.best_keys(df.select(F.col("s").alias("text")), d, block_rows=7)
    assert {r.text: r.value for r in blocks.collect()} == {t: w for t, w in zip(texts, want) if w}
    monkeypatch.setattr(dictionary, "ordered_pairs", lambda x: None)
    assert values(lookup(df, d, "s", "o", "fuzzy"), "o") == want


PLACES = {"paris": "249", "france": "240", "london": "216.44", "new south wales": "817", "wales": "220", "sydney": "817.3",
          "perth": "812", "java": "474", "adelaide": "814.1", "adelaide hills": "814.12"}


def test_places(table, never_small, monkeypatch):
    rows = [(1, "Paris", "France"), (2, "somewhere, London/Java", ""), (3, None, "old New South Wales colony"),
            (4, "the java sea", "Perth"), (5, "Adelaide Hills & Sydney", "x"), (6, "", "nowhere"), (7, "wales; perth", None)]
    want = ["249", "216.44", "817", "812", "814.12", "", "812"]
    df = table("i int, a string, b string", rows)
    assert values(places.match_area(df, "a,zz,b", "o", places=PLACES), "o") == want  # by joins
    monkeypatch.undo()
    assert values(places.match_area(df, "a,zz,b", "o", places=PLACES), "o") == want
    listed = df.select("i", F.array("a").alias("a"), "b")
    assert values(places.match_area(listed, ["a", "b"], "o", places=PLACES), "o") == want
    many = PLACES | {f"place number {i}": "1" for i in range(100)}
    assert values(places.match_area(df, "a,b", "o", places=many), "o") == want
    assert values(places.match_area(df, "zz", "o", places=PLACES), "o") == [""] * 7


def test_default_places(table):
    df = table("i int, a string", [(1, "Tasmania"), (2, "the South Australia company")])
    assert values(places.match_area(df, "a", "o"), "o") == ["819", "814"]


def test_headings(table):
    df = table("i int, country string, state string, city string, theme string", [
        (1, "Australia", "South Australia", "Adelaide", "Mining and more"), (2, "United Kingdom", None, None, None),
        (3, "United States", "", "", "war"), (4, None, None, None, "mining"), (5, "France", None, "['Paris', 'Lyon']", None),
        (6, "Australia", "Victoria", None, "")])
    assert values(subject_headings(df, "country", "state", "city", "theme", "o"), "o") == [
        "Adelaide (S. Aust.) -- Maps; Adelaide (S. Aust.) -- Mines and mineral resources -- Maps; South Australia -- Maps; Australia -- Maps",
        "Great Britain -- Maps; United Kingdom -- Maps",
        "{state} -- Maps -- Maps; United States -- Maps", "",
        "Paris, Lyon -- Maps; France -- Maps", "Victoria (Vic.) -- Maps; Australia -- Maps"]
    assert subject_headings(df, "country").columns[-1] == "subject_lcsh"


def test_registry(spark, table):
    register_dictionary("mine", {"a": "1", "b": "2"})
    counts = {r.name: r.entries for r in dictionary_counts(spark).collect()}
    assert counts["mine"] == 2 and counts["bl_subject_codes"] == 44 and counts["theme_to_bl_subject"] == 51
    assert as_dictionary(spark, "bl_area_codes").count() == counts["bl_area_codes"]


def test_size_checks(spark):
    big = spark.range(100).withColumn("s", F.lit("x" * 50))
    assert session.small_rows(big, max_rows=99) is None
    assert session.small_rows(big, max_bytes=1000) is None
    assert len(session.small_rows(big)) == 100
    assert "ResolvedHint" not in session.broadcast_if_small(big, max_rows=5)._jdf.queryExecution().analyzed().toString()


def test_fuzzy_bounds_leave_few_keys_to_compare(spark):
    """Letter bounds never cut a key that passes, and leave a small part of all pairs to difflib."""
    rng = random.Random(8)
    keys = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(rng.randint(0, 24))) for _ in range(400)] + ["é" * 250, "", "a"]
    texts = [k[1:] + "x" for k in keys[:60]] + [k.replace("a", "") for k in keys[60:120]] + keys[120:130] + ["é" * 240 + "x", "", "zzzz"]
    table = fuzzy.Keys(keys)
    for text in texts:
        ratios = [SequenceMatcher(None, text, k).ratio() for k in keys]
        assert all(b >= r for b, r in zip(table.bounds(text), ratios, strict=True))
        top = max(ratios)
        assert table.best(text) == ((top, ratios.index(top)) if top > fuzzy.LIMIT else None)
    assert table.compared < 0.02 * len(texts) * len(keys)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    bands = {(r.text, r.band) for r in fuzzy.reachable(frame).collect()}
    key_bands = {r.key: r.b for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", fuzzy._band(F.length("key")).alias("b")).collect()}
    for text in texts:
        assert all((text, key_bands[k]) in bands for k in keys if SequenceMatcher(None, text, k).ratio() > fuzzy.LIMIT)


def test_names_that_differ_by_digits_are_told_apart_by_order(spark):
    """Letters in another order do not reach difflib, and one letter more or less needs no comparison of all keys."""
    random.seed(5)
    keys = [f"supplier#{i:06}" for i in random.sample(range(3000), 600)]
    texts = [f"customer#{i:06}" for i in range(0, 3000, 30)]
    table = fuzzy.Keys(keys)
    for text in sorted(texts, key=fuzzy._by_letters):
        ratios = [SequenceMatcher(None, text, k).ratio() for k in keys]
        best = max(ratios)
        assert table.best(text) == ((best, ratios.index(best)) if best > 0.7 else None)
    assert table.compared < 3 * len(texts)
    odd = [k + "?" for k in keys[:20]] + ["s" + k for k in keys[20:40]] + [k[:-1] for k in keys[40:60]] + [keys[60], "su", ""]
    odd += ["abab", "ababa", "aab"]
    named = [*keys, "ababab", "abaab", "ab", "aaab"]
    frame = spark.createDataFrame([(k, f"v{i}", i) for i, k in enumerate(named)], "key string, value string, ord int")
    asked = spark.createDataFrame([(t,) for t in odd], "text string")

    def brute(text):
        ratios = [SequenceMatcher(None, text, k).ratio() for k in named]
        return f"v{ratios.index(max(ratios))}" if max(ratios) > 0.7 else None

    want = {t: brute(t) for t in odd if brute(t) is not None}
    assert {r.text: r.value for r in fuzzy.best_keys(asked, frame, 50).collect()} == want
    near = {r.text: r.value for r in fuzzy.near_keys(asked, frame).collect()}
    assert set(odd[:61]) <= set(near) and near.items() <= want.items()
