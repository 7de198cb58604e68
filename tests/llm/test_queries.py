import hashlib
import sys

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from oracle import same  # noqa: E402

from phyloquarry.llm.registry import registered  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in registered().items() if sql])
def test_against_sql(spark, name):
    same(spark, *registered()[name], SF)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids
    assert 0 < len(ids) <= docs.count()


def plain_pipeline(spark, rows, sf):
    """The rows that each stage keeps, decided in plain Python; rows are (doc_id, text, lang, source, n_chars)."""
    from plain_pii import pseudonymised
    from test_small import brute_classes, hits_brute

    import corpus_pipeline
    from phyloquarry.llm import language_id, pii

    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.CONFIDENT]
    yield kept
    numbered = [(i, r[1]) for i, r in enumerate(kept)]  # rows, as ids may be shared
    groups, classes = {}, brute_classes([(i, t) for i, t in numbered if kept[i][0] is not None])
    for i, (root, _) in classes.items():
        groups.setdefault(root, []).append(i)
    digest = lambda i: hashlib.md5(kept[i][1].encode()).hexdigest()
    stay = {min(g, key=lambda i: (kept[i][0], digest(i))) for g in groups.values()}
    kept = [r for i, r in enumerate(kept) if i in stay or i not in classes]
    yield kept
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [r for r in kept if not hits_brute([r[:2]], items)[r[0]][1]]
    yield kept
    kept = [(i, t := pseudonymised(text, pii.DEMO_KEY)[0], lang, source, len(t)) for i, text, lang, source, _ in kept]
    yield kept


def test_stages_against_plain_ones(spark):
    import corpus_pipeline
    from test_small import words
    from tokenizers import Tokenizer

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()][:120]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    other = " ".join(reversed(long.split()))
    rows += [(9001, long, "en", "z", 1), (9001, long, "en", "z", 1), (9001, other, "en", "z", 1), (9002, other, None, None, 1), (9003, None, "en", "z", 0), (9003, "  ", "en", "z", 0), (None, long, "en", "z", 1)]
    rows += [(9004, long + " " + item, "en", "z", 1), (9005, other + " call a.b@example.org", "en", "z", 1), (9005, " ".join(other.split()[::-2]) + " " + item, "en", "z", 1), (None, item, "en", "z", 1), (9006, words(3, 20_000), "en", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: tuple(str(x) for x in r)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_pipeline(spark, rows, SF), strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        assert sorted((tuple(r) for r in docs.collect()), key=key) == sorted(want, key=key), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    library = Tokenizer.from_file(corpus_pipeline.public_path(corpus_pipeline.TOKENIZER))
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got == {(r[0], hashlib.sha256(np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in want}
