"""The registered queries of the subpackage, and their check SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.llm import bpe, chat, classifier, contamination, licences, manifest, near, private, quality, shards, sql, substring, suffixes, trie
from flowvigil.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def near_dedup(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def chat_format(spark, sf_dir):
    extra = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.fold_and_render(chat.events_of(given.unionByName(extra))))


def quality_rules(spark, sf_dir):
    judged = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), materialise)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def private_data(spark, sf_dir):
    found = private.span_strings(private.find_private(table(spark, sf_dir, "documents")))
    return found.select("doc_id", *(f"n_{k}" for k in private.BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def suffix_dedup(spark, sf_dir):
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def decontamination(spark, sf_dir):
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHARDS = [f"shard-{i:02d}" for i in range(16)]


def sharding(spark, sf_dir):
    placed = shards.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def licence_scan(spark, sf_dir):
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    full = {n: len(t.split()) for n, t in licences.TEMPLATES}
    covered = F.filter("spans", lambda s: s["covered"] >= licences.COVER * F.element_at(_map(full), s["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.transform(covered, lambda s: s["label"]))))
    word = F.col("places.word")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).cast("long").alias("first_word"),
                        F.array_max(word).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
                        F.array_join(labels, ",").alias("labels"), "score")


def merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = manifest.verify(table(spark, sf_dir, "documents"), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(manifest.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
                      "folded_root", "verified")


def prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _map(values: dict[str, int]):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": substring_dedup, "op2_minhash_near_dedup": near_dedup, "op3_chat_format": chat_format,
    "op4_quality_rules": quality_rules, "op5_private_data": private_data, "op6_suffix_dedup": suffix_dedup,
    "op7_decontamination": decontamination, "op8_sharding": sharding, "op9_byte_bpe": byte_bpe,
    "op10_licence_scan": licence_scan, "op11_merkle_manifest": merkle_manifest, "op12_prefix_trie": prefix_trie,
    "op13_quality_classifier": quality_classifier,
    "pipeline": pipeline,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING_SQL = f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
firsts as (select k, min({{'d': doc_id, 'i': i}}) as f from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from win join firsts using (k) where {{'d': doc_id, 'i': i}} > f),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from each anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) using (doc_id)"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\.{control[1:]}')"
    return out


_CHAT_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(replace({_escaped('role')}, chr(10), '\\n')) + length({_escaped('text')}))::bigint as formatted_chars
from c group by conv_id"""


def _grams(of: str, key: str, sizes: str) -> str:
    """The distinct runs of words of the given sizes, as one text each."""
    words = _WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")
    return f"""(select distinct k, array_to_string(w[i:i + size - 1], ' ') as s from (
        select k, w, size, unnest(range(1, len(w) - size + 2)) as i from (select k, w, unnest({sizes}) as size from (select {key} as k, {words} as w from {of}))))"""


_CONTAINED_SQL = f"""
with item as {_grams('benchmark', 'item_id', '[least(5, greatest(len(w), 1))]')}, doc as {_grams('documents', 'doc_id', '[1, 2, 3, 4, 5]')},
size as (select k, count(*) as n from item group by k)
select doc.k as doc_id, item.k as item_id, any_value(n)::bigint as n_shingles, count(*)::bigint as n_found
from doc join item using (s) join size on size.k = item.k group by all having 100 * count(*) >= 80 * any_value(n)"""

_SHARDS_SQL = f"""
with recursive orders as (select i as shard,
    ('0x' || substr(md5(printf('offset:shard-%02d', i)), 1, 12))::bigint % {shards.SLOTS} as o,
    ('0x' || substr(md5(printf('skip:shard-%02d', i)), 1, 12))::bigint % {shards.SLOTS - 1} + 1 as s from range({len(SHARDS)}) r(i)),
fill(step, owner) as (
    select 0::bigint, list_transform(range({shards.SLOTS}), lambda x: -1::bigint)
    union all
    select step + 1, list_transform(owner, lambda v, p: case when p = slot then shard else v end) from (
        select step, owner, shard, list_filter(list_transform(range({shards.SLOTS}), lambda j: (o + j * s) % {shards.SLOTS} + 1),
                                               lambda x: owner[x] < 0)[1] as slot
        from fill join orders on shard = step % {len(SHARDS)} where step < {shards.SLOTS})),
lookup as (select owner from fill where step = {shards.SLOTS})
select doc_id, slot, owner[slot + 1]::integer as shard from lookup, (
    select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint % {shards.SLOTS} as slot from documents)"""

ORACLES: dict[str, str] = {"op1_substring_dedup": _SUBSTRING_SQL, "op3_chat_format": _CHAT_SQL, "op7_decontamination": _CONTAINED_SQL, "op8_sharding": _SHARDS_SQL,
                           "op11_merkle_manifest": sql.MANIFEST, "op12_prefix_trie": sql.TRIE}


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
