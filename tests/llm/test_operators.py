import random

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowvigil.llm import bpe, chat, contamination, licences, near, private, quality, queries, shards, tasks

SCHEMA = "doc_id long, text string, v string, h int, n long, bucket int"
ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (4, "other words here, far away"), (5, "É" * 5000), (6, "word " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "v", 1, 2, 3) for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def docs_of(spark, sf_dir, limit=6000):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"length(text) < {limit}")
    return df, [(r.doc_id, r.text) for r in df.collect()]


# near copies

def edited(seed=1, n=90):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(2000 + i, f"short text {i % 3}") for i in range(6)] + [(3000 + i, " ".join(base[:20 + i])) for i in range(20)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, monkeypatch, size, percent):
    monkeypatch.setattr(near, "STAR_PART", 7)
    monkeypatch.setattr(near, "STAR_SHINGLES", 500)
    for rows in (edited() + ODD[:-1], ODD):
        have = rows_of(near.near_groups(frame(spark, rows), size, percent), "doc_id", "n_shingles", "component_id", F.coalesce("kept", F.lit(True)))
        want = [(i, n, c, k) for i, n, c, k in brute.near(rows, size, percent)]
        assert have == sorted(want, key=str)


def test_near_groups_of_given_documents(spark, small):
    df, rows = docs_of(spark, small)
    assert rows_of(near.near_groups(df, 3, 85), "*") == sorted(brute.near(rows, 3, 85), key=str)
    assert near.near_groups(frame(spark, []), 3, 85).count() == 0


def test_near_groups_of_the_largest_ids(spark, monkeypatch):
    """No number is taken for a null id, and a crowded table of bits loses nothing."""
    monkeypatch.setattr(near, "MARKS", 1)
    top, low = 2**63 - 1, -2**63
    for more in ([], [(low, "g h i j k l")]):
        rows = [(top, "a b c d e f"), (None, "g h i j k l"), (top - 1, "a b c d e f"), (top - 3, "m n o p"), (7, None), (0, "x y z")] + more
        assert rows_of(near.near_groups(frame(spark, rows), 3, 85), "*") == sorted(brute.near(rows, 3, 85), key=str)


def test_finished_steps_are_removed(spark):
    """Only what the lazy result still reads stays in the shared folder."""
    from flowvigil.session import shared_dir
    from flowvigil.sources.folders import Folders
    here = lambda: {e.name for e in Folders(spark).matching(f"{shared_dir(spark)}/near-*")}
    before = here()
    rows = edited()
    out = near.near_groups(frame(spark, rows), 3, 85)
    assert len(here() - before) == 2 and out.count() == len(rows)


def test_links_that_stars_miss(spark):
    """Without any star link the rest of a bucket is still searched."""
    rows = edited(3, 60)
    df = frame(spark, rows)
    made = near.sketches(df, 3)
    classes = made.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("v"), F.first("bands").alias("bands"))
    named = classes.select(F.explode("bands").alias("bucket"), "v", F.col("n_shingles").alias("n"), F.col("v").alias("component"))
    have = {tuple(r) for r in near._rest(named, classes, df, 3, 85, near.Steps(spark)).collect()}
    sets = {i: brute.shingle_set(t, 3) for i, t in rows}
    keep = {r.v for r in classes.collect()}
    want = {(a, b) for a in keep for b in keep if a > b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert have == want and len(want) > 50


def test_one_permutation_estimates():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    parts = [h[:1000], h[100:1000], h[:3], h[:1]]
    off = np.cumsum([0, *map(len, parts)])
    low = near.one_permutation(np.concatenate(parts), off)
    assert not (low == near._EMPTY).any()
    assert abs((low[0] == low[1]).mean() - 0.9) < 0.1
    assert len(set(low[3].tolist())) == 1


# chat

@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/sSINTY[]\\.n ü\n")), st.text(st.sampled_from("<s>[INST]/\n\\n")))
def test_escape(text, role):
    segment = chat.render(role, text, True)
    assert chat.read_back(segment[0]) == (role, text)
    assert chat.unescape(segment[0][segment[1]:segment[2]]) == text
    assert segment[0].count("</s>") == 1 and segment[0].count("[INST]") == 1


def test_chat_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert rows_of(queries.chat_format(spark, small), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(brute.chat(rows), key=str)


def test_chat_fold(spark):
    log = [(1, 1, 0, 0, "message", "user", "hel"), (1, 1, 0, 1, "delta", None, "lo"), (1, 2, 1, 2, "message", "assistant", "no"),
           (1, 2, 1, 3, "regenerate", None, None), (1, 2, 1, 5, "delta", None, "s"), (1, 2, 1, 4, "delta", None, "ye"),
           (1, 1, 0, 6, "edit", None, "Hello"), (None, 3, None, None, None, None, None), (2, 1, 0, 0, "message", "assistant", "</s>\\")]
    segments = chat.fold_and_render(spark.createDataFrame(log, chat.EVENTS))
    have = {(r.conv_id, r.turn): chat.read_back(r.formatted) for r in segments.collect()}
    assert have == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "yes"), (None, None): ("", ""), (2, 0): ("assistant", "</s>\\")}
    assert rows_of(chat.digests(segments), "conv_id", "n_turns", "loss_chars") == sorted([(1, 2, 3), (None, 1, 0), (2, 1, 5)], key=str)
    assert chat.digests(chat.fold_and_render(spark.createDataFrame([], chat.EVENTS))).count() == 0


def test_chat_log_of_turns(spark):
    """The log holds every kind of event, its fold gives the turns back, and neither ties nor the order of rows matter."""
    long = "<s> word [/INST]\\\n" * 20000
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "abc"), ("assistant", "abcd"), ("assistant", "abcde"), ("user", None),
                                                     (None, ""), ("assistant", "é"), ("assistant", "</s>[INST]"), ("assistant", long)])]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "user", "x"), (None, 0, "user", "y")]
    make = lambda r: spark.createDataFrame([(*x, "k", 7) for x in r], "conv_id long, turn long, role string, text string, kind string, seq int")
    log = chat.events_of(make(rows))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    have = rows_of(chat.digests(chat.fold_and_render(log)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    assert have == sorted(brute.chat(ordered), key=str)
    assert rows_of(chat.digests(chat.fold_and_render(chat.events_of(make(rows[::-1])))), *("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == have
    assert chat.events_of(make([])).count() == 0


# quality

def test_statistics(spark, small):
    _, rows = docs_of(spark, small, 3000)
    rows = rows + ODD[:-1] + [(9, "a b a b a b\na b a b\n\n  \na b a b\n"), (10, "# * < é\n# * < é\r\n# * < é")]
    have = rows_of(quality.statistics(frame(spark, rows)), "doc_id", *quality.COUNTS[:5])
    assert have == sorted(((i, *brute.statistics(t)) for i, t in rows), key=str)


def test_statistics_of_many_short_rows(spark):
    texts = [["a b a", "", "a\nb\na", "c"][i % 4] for i in range(9000)]
    have = quality._statistics(pa.table({"doc_id": range(9000), "text": texts}).to_batches()[0])
    want = [brute.statistics(t) for t in texts]
    assert have["n_dup_lines"].to_pylist() == [w[3] for w in want]
    assert have["n_distinct"].to_pylist() == [len(set(t.split())) for t in texts]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "0")
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert {r.n_distinct for r in quality.statistics(df).filter("doc_id % 4 = 2").collect()} == {2}
        assert spark.conf.get(key) == str(tasks.BATCH_ROWS)
    finally:
        spark.conf.set(key, before)


def test_trees_follow_labels_and_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    good = (x[:, 5] > 0.4) & (x[:, 2] < 0.7) | (rng.random(3000) < 0.02)
    model = quality.fit(x[:2000], good[:2000])
    assert ((model.score(x[2000:]) > 0) == good[2000:]).mean() > 0.93
    for f, sign in enumerate(quality.MONOTONE):
        if sign:
            grid = np.repeat(x[:100], 20, 0)
            grid[:, f] = np.tile(np.linspace(0, 1, 20), 100)
            assert (np.diff(model.score(grid).reshape(100, 20), axis=1) * sign >= -1e-12).all()
    for one in (np.ones(50, bool), np.zeros(0, bool)):
        assert len(quality.fit(x[:len(one)], one).roots) == 0


def test_verdicts(spark, small):
    out = queries.quality_rules(spark, small)
    rows = out.collect()
    texts = dict(docs_of(spark, small, 10**9)[1])
    for r in rows:
        n, _, _, _, repeated = brute.statistics(texts[r.doc_id]) if len(texts[r.doc_id]) < 3000 else (r.n_words, 0, 0, 0, r.n_repeat_words)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= 1
    empty = quality.verdicts(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int"), lambda df: df)
    assert empty.count() == 0
    odd = quality.verdicts(frame(spark, ODD), spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"), lambda df: df)
    assert odd.count() == len(ODD)


def test_fit_depends_on_no_order_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), *map(int, rng.integers(60, 400, len(quality.COUNTS)))) for i in range(120) for _ in range(6)]
    labels = spark.createDataFrame([(i, q) for i in range(120) for q in {i % 2, (i % 8 + 7) // 8}], "doc_id long, quality int")
    one = {}
    for r in sorted(rows):
        one.setdefault(r[0], r)
    counts = {c: np.array([one[i][n] for i in range(120)]) for n, c in enumerate(quality.COUNTS, 1)}
    want = quality.fit(quality.features(counts), np.array([min(i % 2, (i % 8 + 7) // 8) for i in range(120)]) > 0)
    for order in (rows, rows[::-1]):
        have = quality.fit_on(spark.createDataFrame(order, quality.STATS).repartition(3), labels, limit=120)
        assert len(want.roots) and all((getattr(have, n) == getattr(want, n)).all() for n in ("feature", "split", "left", "right", "value", "roots"))


# personal data

TRICKY = ["a@b.c@d.e", "x@y z@w.co.uk. +1 (555) 010-9999 4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.256 001.02.3.4",
          "+12 34+1 234 567 89-", "4111-1111-1111-1111-1", "é@é.fr ü.x@a-b.c-d..", "+", "1" * 5000, "0" * 16, "a.b.@c.d.e@f.g", "@@a@b.c"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a@.+- ()0123459é%"), max_size=60))
def test_base_spans(text):
    assert [s for s in private.spans(text) if s[0] in private.BASE_KINDS] == brute.private(text)


def test_private_data(spark, small):
    df, rows = docs_of(spark, small)
    rows += ODD + list(enumerate(TRICKY, 100))
    have = private.span_strings(private.find_private(frame(spark, rows)))
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.private(t))) for i, t in rows]
    assert rows_of(have, "doc_id", "base") == sorted(want, key=str)
    assert private.mask_text('mail a.b@c.org, password = "abc12345678", see https://x.org/y?z now') == 'mail [EMAIL], password = "[SECRET]", see [URL] now'
    assert private.mask_text("IBAN DE89 3704 0044 0532 0130 00 at 12 Long Street") == "IBAN [IBAN] at [ADDRESS]"
    assert private.redact(frame(spark, ODD)).filter("text is null").count() == 1


# licences

def test_licences(spark, small):
    df, rows = docs_of(spark, small)
    rows += ODD + [(9100, "GNU General Public License, the MIT-License cc by CC-BY"), (9101, "the gnu general public gnu general public license"),
                   (9102, "x " + dict(licences.TEMPLATES)["mit"].upper() + " y"), (9103, "Apache  License apache")]
    found = licences.scan_licences(frame(spark, rows))
    labels = F.array_join(F.array_sort(F.array_distinct("places.label")), ",")
    have = rows_of(found, "doc_id", "n_words", F.size("places"), F.array_min("places.word"), F.array_max("places.word"), labels)
    assert have == sorted(((i, *brute.licences(t)) for i, t in rows), key=str)
    mit = found.filter("doc_id = 9102").first()
    assert mit.score == 1.0 and any(s.label == "mit" and s.covered == mit.n_words - 2 for s in mit.spans)


def test_single_word_phrase(spark):
    found = licences.scan_licences(frame(spark, [(1, "x MIT y mit"), (2, "nothing")]), phrases=(("mit", "mit"),)).orderBy("doc_id").collect()
    assert [[tuple(p) for p in r.places] for r in found] == [[(1, "mit"), (3, "mit")], []]


def test_automaton_statistics():
    rng = random.Random(2)
    texts = [("t", [rng.choice("abc") for _ in range(rng.randrange(1, 14))]) for _ in range(12)]
    made = licences.Automaton(texts, [("p", ["a", "b"]), ("q", ["b"])])
    every = {tuple(t[i:j]) for _, t in [*texts, ("", ["a", "b"])] for i in range(len(t)) for j in range(i, len(t) + 1)}
    run = [rng.choice("abcd") for _ in range(400)]
    for i, (size, state) in enumerate(made.statistics(run)):
        best = max(k for k in range(i + 2) if tuple(run[i + 1 - k:i + 1]) in every)
        assert size == best
        assert sorted(x for n, x in made.phrases[state] if n <= size) == sorted(x for x, p in (("p", ["a", "b"]), ("q", ["b"])) if run[max(0, i + 1 - len(p)):i + 1] == p)
        match = run[i + 1 - size:i + 1]
        if size:
            assert {o for o in made.owners[state] if o < len(texts)} == {o for o, (_, t) in enumerate(texts) if any(t[j:j + size] == match for j in range(len(t)))}


# BPE

def test_bpe(spark, small):
    df, rows = docs_of(spark, small, 10**9)
    rows = rows + ODD + [(200, "it's  a   b\n\n c 12 345 <|endoftext|> 日本語 " * 50)]
    file, pattern = queries.tokenizer()
    enc = bpe.encoding(file, pattern)
    decoded = bpe.decode(bpe.encode(frame(spark, rows), file, pattern, cut=300), file, pattern)
    two_passes = decoded.select("doc_id", F.size("ids").cast("long"), F.sha2(F.array_join("ids", " "), 256), F.sha2("data", 256))
    have = rows_of(bpe.round_trip(frame(spark, rows), file, pattern, cut=300), "*")
    assert have == rows_of(two_passes, "*")
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    assert have == sorted(want, key=str)
    assert bpe.decode(bpe.encode(frame(spark, []), file, pattern), file, pattern).count() == bpe.round_trip(frame(spark, []), file, pattern).count() == 0


def test_bpe_of_long_white_space(spark):
    import regex
    file, pattern = queries.tokenizer()
    enc = bpe.encoding(file, pattern)

    def by_match(parts):
        return [i for part in parts for i in enc._encode_single_piece(part)]
    n = 5_000_000
    for c in " \t\n":
        assert bpe.encode_text(enc, c * n).tolist() == by_match([c * n])
        for tail in ("x", "\u00e9", "!"):
            last = [" " + tail] if c == " " else [c, tail]
            assert bpe.encode_text(enc, "a b" + c * n + tail).tolist() == by_match(["a", " b", c * (n - 1), *last])
    mixed = "a" + " \t\u3000\n" * 5000 + "word" + "\u00a0" * 20_000 + "\x1c" + " " * 30_000  # below what the splitter itself can do
    assert bpe.encode_text(enc, mixed).tolist() == by_match(regex.findall(pattern, mixed)) == enc.encode_ordinary(mixed)
    rows = [(1, "a" + " " * n + "b"), (2, "plain")]
    have = bpe.round_trip(frame(spark, rows), file, pattern).select("doc_id", "decoded_sha256").collect()
    assert {r[0]: r[1] for r in have} == {i: brute.sha(t) for i, t in rows}


# decontamination

def test_contained(spark, small):
    docs, rows = docs_of(spark, small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(900, None), (901, " "), (902, "a b c"), (None, "É" * 5000), (900, "other words here, far away")]
    items += [(903, "b"), (904, "B c"), (904, "b  C d e"), (905, "nowhere to be seen"), (906, "b c d e f g h i j k l")]
    rows += ODD + [(300, "x y a b c d e f g h i j k l " * 400), (301, "a c b d e b"), (302, "c d e")]
    item_df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = sorted(brute.contained(rows, items), key=str)
    for size in (1 << 20, 500):
        assert rows_of(contamination.contained(frame(spark, rows), item_df, block_bytes=size), "*") == want
    assert contamination.contained(frame(spark, []), item_df).count() == 0
    assert contamination.contained(frame(spark, rows), item_df.limit(0)).count() == 0


def test_sketch_misses_no_allowed_loss():
    for n in range(1, 300):
        least = min(k for k in range(n + 1) if 100 * k >= 80 * n)
        assert contamination.sketch_size(n, 80) == n - least + 1


# more personal data

PARTS = ["HTTP://X.org/a", "https://é.example", "ftp://a.b:21/c?d", "iban DE89370400440532013000", "IBAN: de89 3704 0044 0532 0130 00", "IBAN DE88370400440532013000",
         "ssn 123-45-6789", "SSN: 666-12-1234", "Social Security Number: 123 45 6789", "assn 123456789", "acct 12345678", "Account No. 123456789012", "account number is 1234567",
         "ABA 021000021", "Routing #: 021000022", "12 Main St", "7 Old Mill Road", "12 main St", "99 Long Acre Stone", "1 Rose Blvd.", "3 The Dr", "PassWord = hunter2hunter",
         "token: abcdefgh", "api-KEY='k3y/k3y/k3y'", "İ", "ß", "\n", "x", "12", "éé"]


def test_added_kinds_by_example():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in private.spans(t) if k not in private.BASE_KINDS]
    assert kinds("see HTTP://X.org/a") == [("url", "HTTP://X.org/a")]
    assert kinds("my iban de89 3704 0044 0532 0130 00.") == [("iban", "de89 3704 0044 0532 0130 00")]
    assert kinds("ssn 123-45-6789, SSN 000-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("acct 12345678 and routing 021000021") == [("account", "12345678"), ("routing", "021000021")]
    assert kinds("at 12 Main St, not 12 Main Stone") == [("address", "12 Main St")]
    assert kinds("the street has 12 accounts, 40 of them new") == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from([" ", ", ", "\n", ""])), max_size=8))
def test_added_kinds(parts):
    text = "".join(a + b for a, b in parts)
    more = [s for s in private.spans(text) if s[0] not in private.BASE_KINDS]
    assert more == brute.private_more(text), text


def test_private_data_of_an_empty_table(spark):
    assert private.find_private(frame(spark, [])).count() == 0 and private.redact(frame(spark, [])).count() == 0


# sharding

def test_shards(spark):
    names = [f"s{i}" for i in range(7)]
    table = shards.fill(names, 251)
    counts = [table.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 251
    fewer = shards.fill(names[:-1], 251)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 251 * 0.2
    df = shards.place(frame(spark, ODD), "doc_id", names, 251)
    assert df.count() == len(ODD) and df.columns[1:-1] == ["doc_id", "text", "v", "h", "n", "bucket"]
    assert df.filter("doc_id = 4").select("_shard").distinct().count() == 1
    clash = shards.place(frame(spark, ODD).withColumn("_slot", F.lit("x")).withColumn("_shard", F.lit("y")), "doc_id", names, 251)
    assert rows_of(clash, "doc_id", "text", "_slot", "_shard") == rows_of(df, "doc_id", "text", "_slot", "_shard")
    for key in ("_slot", "_shard"):
        own = frame(spark, ODD).select(F.col("doc_id").alias(key), F.lit("z").alias("_" + key))
        placed = shards.place(own, key, names, 251)
        new = [("_" + c if c == key else c) for c in ("_slot", "_shard")]
        assert sorted(placed.columns) == sorted([key, *new])
        assert rows_of(placed, key, *new) == rows_of(df, "doc_id", "_slot", "_shard")
    assert shards.place(frame(spark, []), "doc_id", names, 251).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shards.fill(bad)
    with pytest.raises(ValueError):
        shards.fill(["a"], 10)


# check SQL

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_check_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    want = con.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert rows_of(df, *columns) == sorted((tuple(None if v != v else v for v in r) for r in want[columns].astype(object).itertuples(index=False)), key=str)
