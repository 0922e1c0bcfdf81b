"""The pipeline stage by stage against plain Python, and the guard around this part."""

import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import prose, same


def _documents(spark, folder):
    r = random.Random(8)
    stop = ["the", "of", "and", "la", "der"]

    def text(n):
        w = prose(r, n).split()
        return " ".join(x if i % 4 else stop[i % 5] for i, x in enumerate(w))
    item = text(30)
    base = [text(90) for _ in range(6)]
    shared = text(20) + "."
    rows = [(0, base[0]), (1, " ".join(base[0].split()[:-1] + ["x"])), (2, base[0]), (3, "too short"), (4, None), (5, base[1] + "\n" + shared + "\n" + base[2]),
            (6, base[3] + "\n" + shared), (7, text(40) + " " + item + " " + text(30)), (8, base[4]), (9, base[5] + " # # # $ $ $ % % % % & & & & & & &" * 6),
            (10, "word " * 80)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(r, 12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, item)]


def test_pipeline(spark, scratch):
    rows, items = _documents(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, scratch)
        assert docs.columns == names
        docs = docs.checkpoint()
        seen.append(sorted((x.doc_id, x.text, x.n_chars) for x in docs.collect()))
    good, cut, near, clean = seen
    assert [k for k, _, _ in good] == [0, 1, 2, 5, 6, 7, 8]
    gone = brute.removed_lines([x[:2] for x in good])
    assert [(k, t) for k, t, _ in cut] == [
        (k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((k, t), ()))) for k, t, _ in good]
    assert all(n == len(t) for _, t, n in cut)
    classes = brute.near_class([x[:2] for x in cut])
    first = {}
    for c, x in zip(classes, cut):
        first.setdefault(c, x)
    assert near == sorted(first.values())
    leaking = {k for k, _ in brute.leaks([x[:2] for x in near], items)}
    assert leaking == {7} and clean == [x for x in near if x[0] not in leaking]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, x, _ in clean:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, scratch).collect()]
    same(got, want)


def test_every_corpus_query_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
