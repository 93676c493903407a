import sys
from collections import Counter

sys.path.insert(0, __file__.rpartition("/")[0])
import corpus_pipeline
from brute import repeats, rows
from polyagg.llm import mixing, parity_sketch, suffix_array
from polyagg.llm.queries import queries
from pyspark.sql import functions as F
from test_parity_sketch import brute as components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, docs):
    return spark.createDataFrame([(d, t, "en", f"s{i}", None if t is None else len(t)) for i, (d, t) in enumerate(docs)], SCHEMA)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_strings", "mixture", "tokens"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(out) <= docs.count() and all(r.round_trip for r in out)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out) and len({r.doc_id for r in out}) == len(out)


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = table(spark, [(90001, None), (90002, "12 34"), (90003, "")])
    kept = corpus_pipeline.language(spark, docs.unionByName(more), SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {90001, 90002, 90003} and len(ids) > 0.97 * docs.count()


def test_one_of_each_group_stays(spark):
    docs = rows(4, 200)
    kept = Counter((r.doc_id, r.text) for r in parity_sketch.one_of_each(table(spark, docs)).collect())
    where = {}
    for d, n, c in components(docs):
        where.setdefault(c if n else None, set()).add(d)
    blank = Counter((d, t) for d, t in docs if not (t or "").split())
    full = kept - blank
    assert kept & blank == blank
    groups = {c for c in where if c is not None} | ({None} if any(n and c is None for _, n, c in components(docs)) else set())
    assert {d for d, _ in full} == groups and max(full.values()) == 1


def test_repeats_leave_the_text(spark):
    docs = rows(5, 100, size=60, vocabulary=300)
    got = Counter((r.doc_id, r.text, r.n_chars) for r in suffix_array.without_repeats(table(spark, docs)).collect())
    want = Counter()
    for (d, t), (_, xs, gone) in zip(docs, repeats(docs, lambda t: (t or "").encode(), 50), strict=True):
        left = bytes(x for x, g in zip(xs, gone, strict=True) if not g).decode(errors="ignore") if any(gone) else t
        if left or not any(gone):
            want[d, left, None if left is None else len(left)] += 1
    assert got == want


def test_mixture_takes_toxic_text_down(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.mixture(spark, docs, sf)
    assert kept.columns == docs.columns
    mixture, rates, share = mixing.thinning(docs, mixing.quality_domains(labels), "toxic")
    own = mixture.rows.select("doc_id", (F.col("n_tokens") * F.col("member")[2]).alias("t"), F.least(F.lit(1.0), rates.rate()).alias("r"))
    own = own.join(labels, "doc_id", "left").join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").fillna(0, ["kept"])
    sums = {"expected": "sum(r * t) / sum(t)", "drawn": "sum(kept * t) / sum(t)", "sd": "sqrt(sum(r * (1 - r) * t * t)) / sum(t)", "clean": "avg(IF(quality = 1 AND toxic = 0, kept, null))", "toxic": "avg(IF(toxic = 1, kept, null))"}
    r = own.agg(*(F.expr(v).alias(k) for k, v in sums.items())).first()
    assert abs(r.expected - share) < 0.01 and abs(r.drawn - r.expected) < 4 * r.sd and r.clean >= 0.97 and r.toxic < 0.4, (share, r)


def test_odd_rows_in_every_stage(spark):
    """Nulls in each column, repeated rows, an empty and a long text, a column whose name an operator uses inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = " ".join(f"word{i % 9973}" for i in range(200_000))
    odd = [(9001, None, None, None, None), (None, "some words of no id", "en", None, 3), (None, None, None, None, None), (9002, "", "en", "s", 0), (9077, long, "en", "s", len(long)), (9078, "a b", "en", "s", 3), (9078, "a b", "en", "s", 3)]
    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = rows.withColumns({"node": F.lit("x"), "spans": F.lit("x"), "member": F.lit("x"), "ids": F.lit("x")})
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        left[name] = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert "node" not in out.columns and "member" not in out.columns
    assert 9001 not in left["language"] and left["near_duplicates"][9078] == 1 and left["near_duplicates"][9077] == 1
    assert left["repeated_strings"][9078] == 2 and left["repeated_strings"][None] == 2
    assert left["tokens"] == Counter(r.doc_id for r in rows.select("doc_id").collect()) and left["mixture"][9077] <= 1


def test_empty(spark):
    none = table(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id n_shingles component_id", "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4": "doc_id rate", "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id n_words n_removed kept_sha256",
    "op7": "query_id rank vec_id score", "op8": "doc_id held_out lang_pred score", "op9": "doc_id size text_crc32 law shard slot grown_shard",
    "op10": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


def test_queries_have_their_columns(spark):
    for name, query in queries().items():
        df = query(spark, SF)
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns), name
        if name.startswith(("op1_", "op2", "op3", "op4", "op5", "op6", "op8", "op9")):
            assert df.count() == 200, name
    assert {n.split("_")[0] for n in queries()} == set(COLUMNS)
