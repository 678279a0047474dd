"""The pipeline against the same steps by brute force."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
import tiktoken
from test_jaccard import plain as plain_groups

import corpus_pipeline
from periodica.llm import bpe, mixing, quality
from periodica.llm.common import held_out, table

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_run(spark):
    docs = table(spark, FOLDER, "documents")
    field = quality.learn(docs, table(spark, FOLDER, "labels"), ~held_out("doc_id"))
    rows = docs.collect()
    score = quality.score_texts([r["text"] for r in rows], field)
    good = [r for r, s in zip(rows, score) if s >= quality.CUT]
    assert 0 < len(good) < len(rows)
    last = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        last[(r["text"] or "").translate(LOWER)] = r
    once = list(last.values())
    near = plain_groups([(r["doc_id"], r["text"]) for r in once], 5, 80)
    stay = {c for _, n, c in near if n} | {d for d, n, _ in near if not n}
    left = [r for r in once if r["doc_id"] in stay]
    planned = mixing.plan(spark.createDataFrame(left, docs.schema)).collect()
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    text = {r["doc_id"]: r["text"] for r in left}
    expected = sorted(
        (p["doc_id"], library.encode_ordinary(text[p["doc_id"]]))
        for p in planned
        for _ in range(p["copies"])
    )
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in found) == expected
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)


def test_stages_keep_the_columns(spark, make_docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "tokens"]
    good = "The thing and then of it was a good one, he said to her, and on they went then."
    some = make_docs([(1, good, "en", "a"), (2, good, "en", "b"), (3, None), (None, good + " X", "en")])
    for docs in (some, make_docs([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).schema == docs.schema
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_tokens_are_decoded(spark, make_docs):
    texts = {1: "The thing, é and 漢字.", 2: "", 3: None, None: "a\tb  c"}
    docs = make_docs([*texts.items(), (1, texts[1])])
    found = corpus_pipeline.tokens(spark, docs, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "2", "3", "None"]
    for r in found:
        plain = (texts[r["doc_id"]] or "").encode()
        assert r["decoded_sha256"] == sha256(plain).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) and bool(plain) == bool(r["ids"])
