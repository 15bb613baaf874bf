"""Odd tables through every operator and stage: nulls, blanks, long texts, repeats, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.chat import canonical_turns, chats, formatted, read_back
from tidemark.llm.decontaminate import contamination
from tidemark.llm.embedding_dedup import near_vectors
from tidemark.llm.line_dedup import remove_common_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import similarity_components
from tidemark.llm.periodic_runs import collapse_runs
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.quality import quality_scores
from tidemark.llm.sharding import shard_rows
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.warc import archive_pages

NAMES = ["b", "g", "z", "id", "rid", "c0", "c1", "size", "place", "words", "key", "shard", "slot", "P", "R", "one", "tie", "first", "mark", "pos", "text_", "id_", "i_", "root", "node", "score", "y", "x", "taken", "target", "source_size", "pid_"]
LONG = " ".join(f"word{i % 977}" for i in range(250_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "plain words in a row " * 9, "en", "a", 5), (2, LONG, "en", "a", None), (3, "", None, "b", 0), (4, None, "de", None, None), (None, " \t\n ", None, None, 3), (5, "\x00 \x1f é 𝔘   x", "fr", "", 7), (5, "again", "fr", "", 5), (6, "one", "en", "b", 3), (7, "w " * 3000, "en", "b", 1)]
    rows += [rows[0]] * 3 + [(None, None, None, None, None)] * 2 + [(8, LONG, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]).repartition(4).cache()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 0), (6, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "word1 word2 word3"), (2, None), (None, ""), (3, "again")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_operators_return_every_row(spark, docs, tables):
    labels, items = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    n = docs.count()
    for out in (
        quality_scores(docs, labels), toxicity_scores(docs, labels), similarity_components(docs), mix_sources(docs), remove_repeats(docs, 35, ["doc_id", "b", "z"]), remove_common_lines(docs, keep=["doc_id", "rid"]), shard_rows(docs, 7), contamination(docs, items), collapse_runs(docs, keep=["doc_id", "b"], planted=True),
    ):
        assert out.count() == n, out.columns
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *[c for c in NAMES if c != "id"])
    assert archive_pages(pages).count() == n
    vecs = docs.select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") < 6, F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float"))).alias("embedding"), F.col("n_chars").cast("int").alias("label"), *NAMES)
    assert near_vectors(vecs).count() == n


def test_copies_and_long_texts(docs):
    got = {(r.doc_id, r.n_words): r.n_removed for r in remove_repeats(docs, 35, ["doc_id"]).collect()}
    assert got[2, 250_000] == 250_000 and got[8, 250_000] == 250_000 and got[7, 3000] == 3000
    comp = similarity_components(docs).where("doc_id = 8").first()
    assert comp.component_id == 2


def test_stages(spark, docs, tables):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "sharding":
            assert out.columns == docs.columns, name
        out.count()
        empty = stage(spark, docs.limit(0), tables)
        assert empty.count() == 0, name


def rows_of(df, *names):
    return sorted(([r[n] for n in names] for r in df.collect()), key=str)


def test_values_of_odd_rows(spark, docs, tables):
    labels, items = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    for scores in (quality_scores, toxicity_scores):
        got = {}
        for r in scores(docs, labels).collect():
            assert 0 <= r.score <= 1 and r.predicted in (0, 1)
            got.setdefault((r.text or "").strip(" \t\n"), set()).add(r.score)
        assert all(len(v) == 1 for v in got.values()), [(k[:20], v) for k, v in got.items() if len(v) > 1]  # equal texts, and all without words, have one score
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in similarity_components(docs).collect()}
    assert comp[1, 5] == 1 and comp[2, 977] == comp[8, 977] == 2 and comp[3, 0] == 3 and comp[4, 0] == 4 and comp[None, 0] is None and comp[5, 1] == comp[5, 1]
    mixed = mix_sources(docs).collect()
    assert {(r.doc_id, r["size"]) for r in mixed} >= {(1, 45), (2, 250_000), (3, 0), (4, 0), (None, 0), (7, 3000)} and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    placed = shard_rows(docs, 7).collect()
    assert {r["size"] for r in placed if r.doc_id in (3, 4)} == {16} and len({r.shard for r in placed if r.doc_id in (2, 8)}) == 1
    for k in range(7):
        slots = sorted(r.slot for r in placed if r.shard == k)
        assert slots == list(range(len(slots)))
    hit = {(r.doc_id, r.n_words): (r.n_hit, r["items"], r.contaminated) for r in contamination(docs, items).collect()}
    assert hit[2, 250_000] == hit[8, 250_000] == (768, ["1"], False) and hit[5, 1] == (1, ["3"], True) and hit[4, 0] == (0, [], False)
    lines = rows_of(remove_common_lines(docs, keep=["doc_id"]).where("doc_id in (1, 2, 3, 4, 8)"), "doc_id", "n_lines", "n_removed")
    assert lines == sorted([[1, 1, 0], [1, 1, 1], [1, 1, 1], [1, 1, 1], [2, 1, 0], [8, 1, 1], [3, 1, 0], [4, 0, 0]], key=str)
    pages = archive_pages(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html")))
    empty = rows_of(pages.where("payload_bytes = 0"), "page_id", "payload_digest", "record_type", "refers_to")
    none = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert empty == sorted([[3, none, "response", None], [4, none, "revisit", 3], [None, none, "revisit", 3], [None, none, "revisit", 3]], key=str)
    vecs = docs.where("doc_id = 1 or doc_id = 3").select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), F.col("n_chars").cast("int").alias("label"))
    assert rows_of(near_vectors(vecs), "vec_id", "n_links", "component_id", "kept") == [[1, 3, 1, True]] * 4 + [[3, 0, 3, True]]


def test_runs_of_odd_rows(docs):
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], len(r.kept_text.split())) for r in collapse_runs(docs, keep=["doc_id"]).collect()}
    assert got[1, 45] == ([(0, 45, 5)], 5) and got[2, 250_000] == got[8, 250_000] == ([(0, 250_000, 977)], 977) and got[7, 3000] == ([(0, 3000, 1)], 1)
    assert got[3, 0] == got[4, 0] == got[None, 0] == ([], 0)


def test_conversations_of_odd_rows(spark, docs):
    """Documents as turns: null ids, roles and texts, ties of (id, turn), a text of 250,000 words, repeated rows."""
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "text", *[c for c in NAMES if c != "target"])
    nodes = conversation_trie(turns).collect()
    root = next(r for r in nodes if r.depth == 0)
    assert root.n_convs == 8 and root.conv_id == 1 and {r.depth for r in nodes if r.conv_id == 1} == {0, 1, 2, 3, 4}
    assert sum(r.n_children for r in nodes) == len(nodes) - 1 and root.n_leaves == sum(r.n_children == 0 for r in nodes)
    assert next(r for r in nodes if r.conv_id == 2 and r.depth == 1).n_convs == 2  # 2 and 8 have one text
    assert conversation_trie(turns, every=100).where("depth = 0").first().n_convs == 8
    out = {r.conv_id: r for r in read_back(formatted(canonical_turns(chats(turns)))).collect()}
    assert len(out) == 9 and len(out[1].turns) == 4 and len(out[None].turns) == 3 and out[2].turns[0].text == LONG and out[4].turns[0].text == ""
    assert all(r.learned == "" for r in out.values())
    assert chats(turns.limit(0)).count() == 0 and conversation_trie(turns.limit(0)).count() == 0
