import random
import re
from pathlib import Path

import corpus_pipeline
from graphloom.llm import divergence_rules, tiling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    common = divergence_rules.COMMON["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(n)) + "."


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    clean = [prose(rng, 120) for _ in range(30)]
    item = prose(rng, 40)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s", 1), (101, clean[1].rsplit(" ", 3)[0] + " x y z.", "en", "s", 1)]
    rows += [(102, clean[2][:300] + " " + item + " " + prose(rng, 80), "en", "s", 1), (103, "a b c " * 40, "en", "s", 1), (104, None, None, None, None)]
    mail = "write to a.b@c.de now " + prose(rng, 100)
    rows += [(105, mail, "en", "s", len(mail)), (105, mail, "en", "s", len(mail)), (None, prose(rng, 90), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, texts = [], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
            path = f"{tmp_path}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            texts = {r.doc_id: r for r in docs.collect()}
        ids.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect()))
    first = [-1, *range(30)]
    assert ids == [[*first, 100, 101, 102, 105, 105], [*first, 102, 105], [*first, 105], [*first, 105], [*first, 105]]
    assert "[EMAIL]" in texts[105].text and "@" not in texts[105].text and texts[105].n_chars == len(texts[105].text)
    assert texts[3].text == clean[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[-1])
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_columns_of_any_name_and_type_pass_through(spark, tmp_path):
    rng = random.Random(2)
    texts = [prose(rng, 90) for _ in range(6)]
    extra = "`a.b` string, `x y` int, class_id long, row string, kept boolean, tags map<string,int>, spans array<string>"
    rows = [(i, t, "en", "s", len(t), "d", 1, 2, "r", False, {"k": 1}, ["z"]) for i, t in enumerate(texts)]
    rows += [rows[0], (0, texts[0], None, None, None, None, None, None, None, None, None, None), (None, texts[1], None, None, None, "d", None, None, None, None, {}, [])]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()) == [-1, 0, 1, 2, 3, 4, 5]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 7


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "graphloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"graphloom\.llm|corpus_pipeline|from \.+llm", path.read_text()), path


def test_min_match_is_the_documented_one():
    assert tiling.MIN_MATCH == 5
