"""The pipeline stage by stage on a small corpus in which every decision is known."""

import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from vigia.llm import line_dedup
from vigia.llm.common import table

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    syllables = ["tha", "ing", "er", "on", "st", "re", "le", "in", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(20))) for i in range(5)]
    docs, labels, planted = {}, [], {"toxic": set(), "copies": set(), "leaks": set(), "lines": set()}
    for i in range(700):
        w = prose(rng.randint(60, 120))
        if i % 7 == 0:
            planted["toxic"].add(i)
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["zorgum", "blefty", "krampo"]))
        labels.append((i, int(i % 7 == 0)))
        text = " ".join(w)
        if i % 10 == 1 and i % 7:
            planted["lines"].add(i)
            text += "\nAll rights of this line are repeated\nlast words " + word()
        if i % 31 == 2 and i % 7:
            planted["leaks"].add(i)
            text = text.replace(" ", f" {rng.choice(items)[1]} ", 1)
        docs[i] = text
    for i in range(1_000, 1_030):  # of clean documents without the repeated line
        source = 7 * (i - 1_000) + 3
        while source in planted["toxic"] | planted["lines"] | planted["leaks"]:
            source += 1
        planted["copies"].add(i)
        w = docs[source].split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        docs[i] = " ".join(w)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(2_000, "", "en", None, 0), (2_001, None, None, "s", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, planted


def test_every_stage(spark, corpus):
    folder, texts, planted = corpus
    docs = table(spark, folder, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        left[name] = {r["doc_id"] for r in rows}
        if name != "byte_bpe":
            assert docs.columns == NAMES
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "line_dedup":
            for r in rows:
                assert "rights of this line" not in (r["text"] or "")
                assert r["text"] is None or r["n_chars"] == len(r["text"])
                if r["doc_id"] in texts and r["doc_id"] not in planted["lines"]:
                    assert r["text"] == texts[r["doc_id"]]
            cleaned = {r["doc_id"]: r["text"] or "" for r in rows}
    everything = set(texts) | {2_000, 2_001}
    assert left["toxicity"] == everything - planted["toxic"]
    assert left["line_dedup"] == left["toxicity"]
    assert left["jaccard_join"] == left["toxicity"] - planted["copies"]
    assert left["decontamination"] == left["jaccard_join"] - planted["leaks"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.BYTE_RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert left["byte_bpe"] == left["decontamination"]
    for r in docs.collect():
        ids = library.encode_ordinary(cleaned[r["doc_id"]])
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids) and r["round_trip"]


def test_near_copies_are_dropped_by_row(spark):
    rng = random.Random(2)
    prose = lambda: [f"w{rng.randrange(10_000)}" for _ in range(60)]
    a, b, c, d, e = (prose() for _ in range(5))
    near = [*b[:-1], "changed"]
    rows = [(3, b), (5, a), (5, b), (5, near), (7, c), (7, c), (8, c), (None, c), (None, d), (None, d), (9, e), (9, ["only", *e]), (1, []), (1, [])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", k) for k, (i, w) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == NAMES
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    kept = [r for r in got if r[0] != 9]
    assert kept == sorted([(3, " ".join(b)), (5, " ".join(a)), (7, " ".join(c)), (None, " ".join(d)), (1, ""), (1, "")], key=str)
    assert [r[1] in (" ".join(e), "only " + " ".join(e)) for r in got if r[0] == 9] == [True]


def test_run_applies_the_stages(spark, corpus):
    folder, texts, planted = corpus
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    gone = planted["toxic"] | planted["copies"] | planted["leaks"]
    assert got == (set(texts) | {2_000, 2_001}) - gone
    assert corpus_pipeline.ORACLE_SQL is None


CLASHING = ["score", "predicted", "hits", "n_lines", "n_dropped", "dropped", "kept", "near_row", "row", "id", "given", "text id", "key"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_columns_of_any_name_alone(spark, corpus, stage):
    folder, _, _ = corpus
    docs = table(spark, folder, "documents").where("doc_id < 60 OR doc_id >= 1000")
    more = docs.selectExpr("*", *(f"concat('own ', {i}) AS `{c}`" for i, c in enumerate(CLASHING)))
    out = stage(spark, more.repartition(2), folder)
    assert out.columns == more.columns
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert kept == {(r["doc_id"], r["text"]) for r in stage(spark, docs.repartition(2), folder).collect()}
    for i, c in enumerate(CLASHING):
        assert out.where(out[f"`{c}`"] != f"own {i}").isEmpty()
    assert stage(spark, more.limit(0), folder).collect() == []


def test_line_dedup_leaves_columns_of_any_name_alone(spark):
    rows = [(i, "same line\nown " + str(i), "d", "k", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, dropped string, kept string, `dropped id` int")
    out = line_dedup.dedup_lines(docs)
    got = {tuple(r) for r in out.collect()}
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert got == {(i, f"own {i}", "d", "k", i, 2, 1) for i in range(12)}
