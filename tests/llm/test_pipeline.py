"""The pipeline: what each stage keeps, what the whole writes, what it leaves behind."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from runlore import session
from runlore.llm import decontam, langid, mixing, simhash
from runlore.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows, run one after the other."""
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = session.cut_lineage(stage(spark, docs, SF_DIR))
        out.append((name, docs, result))
        docs = result
    return out


def test_stages_come_in_order_and_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]
    for _, _, result in stages[:-1]:
        assert result.columns == COLUMNS


def test_each_stage_does_what_its_operator_says(spark, stages):
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, docs, spoken), (_, _, single), (_, _, clean), (_, _, shown), (_, _, mix) = stages
    assert ids(spoken) == sorted(r.doc_id for r in langid.op8(docs).collect() if r.lang_pred != "und")
    first = {r.component_id for r in simhash.op4(spoken).collect()}
    assert ids(single) == sorted(first)
    marks = decontam.op10(single, table(spark, SF_DIR, "benchmark")).collect()
    assert ids(clean) == sorted(r.doc_id for r in marks if not r.contaminated)
    assert ids(shown) == ids(clean)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text) for r in shown.collect())
    taken = {r.doc_id: r.copies for r in mixing.mixed(shown).collect()}
    rows = mix.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, n in taken.items() for _ in range(n))
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append((words(r.text), r.target))
    largest = {}
    for r in shown.collect():
        largest[r.source] = max(largest.get(r.source, 0), words(r.text))
    for source, own in per.items():
        assert abs(sum(n for n, _ in own) - own[0][1]) <= largest[source]


def test_whole_run_equals_the_stages_and_leaves_nothing(spark, stages):
    root = Path(session.checkpoint_root(spark).replace("file:", ""))
    before = {p.name for p in root.glob("runlore-*")}
    with session.temporary_tables(spark):
        got = sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect()))
        assert len({p.name for p in root.glob("runlore-*")} - before) == 1
    assert {p.name for p in root.glob("runlore-*")} == before
    assert got == sorted(map(str, stages[-1][2].collect()))


def test_nulls_repeated_rows_maps_and_clashing_names(spark, tmp_path):
    odd = [(9001, None, None, None), (9002, "", "en", "a"), (9003, "one text of some words", "en", "a"), (9003, "one text of some words", "en", "a"),
           (None, "another text by nobody", None, None), (9005, " \t", "en", None), (9006, "z " * 50_000, "en", "b")]
    plain = table(spark, SF_DIR, "documents").limit(60)
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in odd], plain.schema).unionByName(plain)
    extra = ["doc_id as id", "text as row", "source as key", "1 as node", "2 as source_size", "3 as copies", "4 as size",
             "map('k', map('a', doc_id)) as m", "5 as label", "6 as copy"]
    full = docs.selectExpr("*", *extra)
    for folder, frame in (("full", full), ("none", docs.limit(0))):
        where = tmp_path / folder
        frame.write.parquet(str(where / "documents.parquet"))
        table(spark, SF_DIR, "benchmark").write.parquet(str(where / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(where)).collect()
        assert (len(rows) > 0) == (folder == "full")
        if rows:
            assert {"id", "row", "key", "node", "m", "label"} <= set(rows[0].asDict())
            assert not {9001, 9002, 9005} & {r.doc_id for r in rows}
