"""The pipeline against each stage's decisions by brute force, and its handling of edge rows."""

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import public_tokenizers as P
import tiktoken
from edge import docs
from test_ngram_jaccard import brute

import corpus_pipeline
from gridloom.llm.byte_bpe import read_ranks
from gridloom.llm.common import materialize


def test_stages_by_brute_force(spark, small):
    kept = materialize(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{small}/documents.parquet"), small), "test")
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(rows) >= 199  # every document here is in a known language
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x).strip(" \t\n\x0b\x0c\r")
    count = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} - {""})
    rows = {i: "\n".join(x for x in t.split("\n") if count[key(x)] < 10) for i, t in rows.items()}
    rows = {i: rows[i] for i, _, c in brute(list(rows.items())) if i == c}
    norm = lambda t: " ".join((t or "").lower().split())
    items = [norm(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    exact = {i for i, t in rows.items() if any(x in norm(t) for x in items)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert exact and not exact & set(got) and len(set(rows) - exact - set(got)) <= 2 and set(got) <= set(rows)
    for i, r in got.items():
        assert r["decoded_sha256"] == hashlib.sha256(rows[i].encode()).hexdigest() and r["n_tokens"] == len(encoding.encode_ordinary(rows[i]))


def test_edge_rows_pass_all_stages(spark, small):
    for df in (docs(spark), docs(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, df, small), "test")
            assert out.columns == df.columns
            df = out
        assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == df.count()


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "gridloom"):
        subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "gridloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'patch_metrics' in q and not any(x.startswith('op1_') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
