"""The pipeline's stages, each on its own input."""

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from sagebrush.llm.common import written
    from sagebrush.llm.decontaminate import op9_decontaminate
    from sagebrush.llm.simhash import op8_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), name))
        if name != P.STAGES[-1][0]:
            assert tables[-1].columns == columns
    start, language, near, clean, mixed, ids = tables

    def keys(df, condition="true"):
        return {r.doc_id for r in df.filter(condition).collect()}

    assert keys(language) == {r.doc_id for r in start.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert keys(near) == keys(op8_simhash(language), "doc_id = component_id")
    assert keys(clean) == keys(op9_decontaminate(near, spark.read.parquet(f"{SF}/benchmark.parquet")), "not contaminated")
    assert keys(mixed) == keys(clean)
    assert ids.count() == mixed.count() and keys(ids) == keys(mixed)
    total = ids.agg({"n_tokens": "sum"}).first()[0]
    last = ids.orderBy("start", ascending=False).first()
    assert last.start + last.n_tokens == total
    assert P.run(spark, SF).count() == ids.count()
    assert P.run(spark, SF).count() == ids.count()


def test_language_stage_rejects_only_texts_without_letters(spark, docs, rows):
    from pyspark.sql import functions as F

    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    want = sorted(str(r[0]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    for lang in (F.col("lang"), F.lit(None).cast("string"), F.lit("und")):
        kept = P.language_id(spark, odd.withColumn("lang", lang), SF)
        assert kept.columns == odd.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_language_stage_labels_by_its_prediction(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wrong = odd.limit(0).unionByName(spark.createDataFrame(
        [(9000 + i, "der und ein nicht Straße größer " * 5, "de" if i else "en", "s", 1) for i in range(6)], odd.schema))
    labelled = {r.doc_id: r.lang for r in P.language_id(spark, odd.unionByName(wrong), SF).collect() if (r.doc_id or 0) >= 9000}
    assert labelled == {9000 + i: "de" for i in range(6)}


def test_stages_on_odd_rows(spark, docs, nothing, rows, lower):
    """All stages in a row against plain loops: letters, links of fingerprints, windows of items, and the library's ids."""
    import re
    import zlib

    import numpy as np
    from public_tokenizers import path
    from test_brute_force import classes, simhash
    from tokenizers import Tokenizer

    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    now = odd
    for _, stage in P.STAGES:
        now = stage(spark, now, SF)
    kept = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    named = [(i, simhash(t, lower)) for i, t in kept if i is not None]
    roots = classes([f for _, f in named], [i for i, _ in named])
    gone = {i for (i, _), c in zip(named, roots, strict=True) if i != c}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def windows(text, of_item):
        w = word.findall(lower(text or ""))
        return {" ".join(w[k:k + 10]) for k in range(max(1, len(w) - 9) if w and of_item else max(0, len(w) - 9))}

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    whole = set().union(*(windows(r.text, True) for r in items))
    assert min(len(w.split(" ")) for w in whole) == 10      # or shorter items would have to be searched too
    clean = {(i, t) for i, t in kept if i not in gone and not windows(t, False) & whole}
    encoder = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    want = {}
    for i, t in clean:
        ids = np.array([*encoder.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] = zlib.crc32(ids.tobytes())
    got = now.collect()
    assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {(r.doc_id, r.n_tokens): r.ids_crc32 for r in got} == want and len(clean) > 20
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    empty = nothing.select(odd.columns)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0 and empty.columns == now.columns
