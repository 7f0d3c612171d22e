from __future__ import annotations

import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from vacancia.llm import quality, shared
from vacancia.llm.labelled import sample
from vacancia.llm.shared import written

from ..conftest import ROOT, SF
from .test_documents import brute_components, brute_contamination, brute_secrets, spaced

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def plain(spark, rows, path):
    """A documents table of these rows."""
    made = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(made, PLAIN).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_their_rules(spark):
    """Every stage on what its predecessor kept, compared with the rule applied row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(held) == docs.count()

    model = quality.QualityModel.fit(*sample(docs, labels, "quality", {0: 2000, 1: 2000}, 32 << 10, 3))
    coders = quality.Compressors(model.dictionaries, model.level, model.chunk)
    want = {i: t for i, t in held.items() if float(model.score(coders_features(coders, t))[0]) >= 0.3}
    docs = written(STAGES["quality"](spark, docs, SF), "test-quality")
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want and 0 < len(want) < len(held)

    least = {i: c for i, _, c in brute_components(list(want.items()))}
    want = {i: t for i, t in want.items() if least[i] == i}
    docs = written(STAGES["near_dedup"](spark, docs, SF), "test-near")
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want and len(want) < len(least)

    want = {i: t for i, t in want.items() if not brute_contamination(t, items)[1]}
    docs = written(STAGES["decontamination"](spark, docs, SF), "test-clean")
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want

    hidden = {i: covered(t) for i, t in want.items()}
    docs = written(STAGES["secrets"](spark, docs, SF), "test-secrets")
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == hidden
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    from .test_tokens import truth

    packed = STAGES["packing"](spark, docs, SF)
    tokens = Counter()
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert tokens == {i: len(ids) + 1 for i, ids in zip(hidden, truth(hidden.values()))}


def coders_features(coders, text):
    import numpy as np

    return np.array([coders.features((text or "").encode())])


def covered(text):
    """text with every span that brute force reports replaced by its kind."""
    spans = [x.split(":") for x in brute_secrets(text or "")[2].split(",") if x]
    out, at, high = [], 0, -1
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):
        if a >= high:
            out += [text[at:a], f"[{kind}]"]
        high = at = max(high, b)
    return "".join(out) + text[at:] if spans else text


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = plain(spark, [], f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_stages_on_tricky_rows(spark, rows, tmp_path):
    rows = [*rows, (70, "same id, one text " * 3), (70, "the same id with quite another text here"), (70, "same id, one text " * 3)]
    docs = plain(spark, rows, f"{tmp_path}/documents.parquet")
    once = written(STAGES["near_dedup"](spark, docs, SF), "test-near")
    assert once.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in once.collect())
    assert max(got.values()) == 1
    least = {}
    for i, _, c in brute_components(rows):
        least.setdefault(i, set()).add(c)
    for i, t in rows:
        if i is None or not spaced(t):
            assert got[i, t] == 1
    assert sum(i in (10, 11, 12, 13) for i, _ in got) == 1
    assert {t for i, t in got if i == 70} == {t for i, t in rows if i == 70}
    for name in ("quality", "decontamination", "secrets"):
        out = STAGES[name](spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
    assert STAGES["secrets"](spark, docs, SF).count() == len(rows)
    assert STAGES["packing"](spark, docs, SF).selectExpr("sum(length)").first()[0] > 0


def test_entry_without_these_folders(tmp_path):
    """With both folders gone but for what git leaves behind, the other queries stay."""
    copy = f"{tmp_path}/repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    os.makedirs(f"{copy}/vacancia/llm/__pycache__")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(o) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, check=True)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    try:
        shared.shared_root(Fake)
    except ValueError:
        return
    raise AssertionError


def test_written_tables_can_be_removed(spark):
    table = written(spark.range(5), "test-removed")
    path = shared._made[-1]
    assert table.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    kept, shared._made[:] = shared._made[:-1], [path]
    assert shared.remove_written() == 1 and not os.path.exists(path.removeprefix("file://"))
    shared._made[:] = kept
