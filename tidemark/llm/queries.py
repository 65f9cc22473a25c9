"""The queries opN_<name>: each operator over its whole table, and digests of its results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, licenses, packing, pii, secrets, topk, toxicity
from .common import crc_mod, read


def _joined(spans):
    """kind:start:end, comma-joined, of an array of spans in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ","
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *map(count, pii.BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema
    )
    parts = chat.format_conversations(turns.unionByName(own))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of a conversation follow one another in their task, in order."""
        rows = ((c, n, t, m) for b in batches for c, n, t, m in zip(*(x.to_pylist() for x in b.columns)))
        out, row = [], next(rows, None)
        while row is not None:
            conv, seen, chars, loss_chars = row[0], hashlib.sha256(), 0, 0
            loss = hashlib.sha256()
            n_turns = 0
            state = {"row": row}

            def own() -> Iterator[str]:
                nonlocal chars, loss_chars
                first = True
                while state["row"] is not None and (first or state["row"][1] > 0):
                    first = False
                    _, _, text, marks = state["row"]
                    chars += len(text)
                    for m in marks:
                        plain = chat.unescape(text[m["start"] : m["end"]])
                        loss_chars += len(plain)
                        loss.update(plain.encode("utf-8", "surrogatepass"))
                    yield text
                    state["row"] = next(rows, None)

            for kind, piece in chat.read_turns(own()):
                seen.update((piece if kind == "text" else piece + "\n").encode("utf-8", "surrogatepass"))
                n_turns += kind == "end"
            out.append((conv, n_turns, seen.hexdigest(), loss_chars, loss.hexdigest(), chars))
            row = state["row"]
            if len(out) >= 5000 or row is None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*out)],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                )
                out = []

    return parts.mapInArrow(
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans")
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "lang_mix.lang_pred",
        "lang_mix.score"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, then its language, then its id."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"
    )
    return licenses.scan(docs, licenses.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_decontamination, op3_toxicity, op4_chat_format, op5_jaccard, op6_secrets, op7_top_k,
        op8_language, op9_packing, op10_licenses
    )
}

_ESCAPED = "(" + "|".join(re.escape(x) for x in ("\\", *chat.CONTROLS)).replace("'", "''") + ")"


ORACLES: dict[str, str] = {
    "op7_top_k": """
with v as (select vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
           where embedding is not null and len(embedding) > 0
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as
  rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    # Turns by turn, role and text; every control string and backslash in a text takes one more character.
    "op4_chat_format": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(role, '{_ESCAPED}', '\\1x', 'g')) +
  length(regexp_replace(text, '{_ESCAPED}', '\\1x', 'g')) + {sum(map(len, (chat.OPEN, chat.CLOSE, chat.END)))} as
  chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), ''
  order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as
    loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars from e group by conv_id""",
    "op5_jaccard": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then
  list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then
  [array_to_string(w, ' ')] else [] end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
e as (select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id and a.n * 4 >=
  b.n * 3 and b.n * 4 >= a.n * 3
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r as (select a as doc_id, a as c from e union select e.b, r.c from r join e on r.doc_id = e.a )
select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
  least(s.doc_id, coalesce(min(r.c), s.doc_id)) as component_id from s left join r on r.doc_id = s.doc_id
  group by s.doc_id, len(s.s)""",
}
