import itertools

import numpy as np
import pandas as pd
import pytest

from cellorium.llm import language, leaks, packing

DOCS = "doc_id long, text string, lang string, source string, k string, t string, eval_id long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lg, s, "k", "t", 1) for i, t, lg, s in rows], DOCS)


def test_differencing_is_near_equal():
    rs = np.random.RandomState(0)
    for n, k in ((50, 5), (200, 13), (7, 7), (3, 5)):
        sizes = rs.randint(1, 100, n).tolist()
        w = packing.differencing(sizes, k)
        assert sorted(i for x in w for i in x) == list(range(n)) and len(w) <= k
        sums = [sum(sizes[i] for i in x) for x in w]
        if n >= 5 * k:
            assert max(sums) - min(sums) <= max(sizes) / 4


def test_packing_against_best():
    rs = np.random.RandomState(1)
    for _ in range(20):
        sizes = rs.randint(1, 11, 8).tolist()
        windows = packing.pack_block(sizes, 10)
        assert all(sum(sizes[i] for i in w) <= 10 for w in windows)
        best = next(k for k in range(1, 9) if any(all(sum(s for s, b in zip(sizes, a) if b == j) <= 10 for j in range(k)) for a in itertools.product(range(k), repeat=8))) if sum(sizes) <= 30 else None
        assert best is None or len(windows) <= best + 1


def test_pack_documents(spark):
    long = "The old lantern near the harbour was cleaned. " * 900
    rows = [(1, long, "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (3, "twice", "en", "s"), (None, "no id", "en", "s")] + [(100 + i, "some words here " * (i % 50 + 1), "en", "s") for i in range(800)]
    p = packing.pack_documents(_docs(spark, rows).coalesce(1), block=256).toPandas()
    assert p.groupby("container_id").n_tokens.sum().max() <= 1024
    one = p[p.doc_id == 1]
    n = packing.token_counts([long])[0]
    assert one.n_tokens.sum() == n == one.text_tokens.iloc[0] and sorted(one.start_token) == [i * 1024 for i in range(-(-n // 1024))]
    assert p[(p.text_tokens <= 1024)].piece_no.max() == 0
    assert p[p.doc_id.isin([2])].container_id.isna().all() and len(p[p.doc_id == 3]) == 2
    used = p.dropna(subset="container_id")
    assert used.n_tokens.sum() / (1024 * used.container_id.nunique()) > 0.97
    assert packing.pack_documents(_docs(spark, [])).count() == 0


def _passages():
    return pd.DataFrame({"eval_id": [1, 2, 3, 4, 5], "passage": ["Before dawn, the mechanic sold the heavy doors and noted 3187 litres near Brebur.", "Before dawn, the mechanic sold the heavy doors and noted 3187 litres near Brebur.", "Кого́ нашёл старый рыбак возле дома утром вчера?", None, "too short"]})


def test_leaks_found(spark):
    items = spark.createDataFrame(_passages(), "eval_id long, passage string")
    rows = [
        (10, "xx BEFORE dawn the mechanic sold the heavy do⁠ors and counted", "en", "s"),  # eight words and more
        (11, "dawn the mechanic sold the heavy doors or noted", "en", "s"),  # seven in a row
        (12, "так кого нашел старый рыбак возле дома утром вчера да", "ru", "s"),
        (13, None, None, None), (14, "", "", ""), (15, "nothing of the kind", "en", "s"), (16, "filler " * 50_000 + _passages().passage[0], "en", "s"),
        (17, "before dawn the mechanic sxld the heavy doors and noted", "en", "s"),
    ]
    got = leaks.leaked_passages(_docs(spark, rows), items).toPandas()
    runs = {(r.doc_id, r.eval_id) for r in got[got.shares_run].itertuples()}
    assert runs == {(10, 1), (10, 2), (12, 3), (16, 1), (16, 2)}
    assert (17, 1) in {(r.doc_id, r.eval_id) for r in got[~got.shares_run].itertuples()}
    assert not {13, 14, 15} & set(got.doc_id)
    r = got[(got.doc_id == 16) & (got.eval_id == 1)].iloc[0]
    assert r.first_char == 7 * 50_000 and r.end_char - r.first_char == len(" ".join(leaks.words_of(_passages().passage[0])))
    assert leaks.leaked_passages(_docs(spark, rows), items, block_items=2).filter("shares_run").count() == 5
    assert leaks.leaked_passages(_docs(spark, []), items).count() == 0
    assert leaks.leaked_passages(_docs(spark, rows), items.limit(0)).count() == 0


def test_no_shared_run_is_lost(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    index: dict = {}
    for r in items.collect():
        w = leaks.words_of(r["passage"])
        for i in range(len(w) - 7):
            index.setdefault(tuple(w[i : i + 8]), set()).add(r["eval_id"])
    want = set()
    for r in docs.collect():
        w = leaks.words_of(r["text"])
        want |= {(r["doc_id"], e) for i in range(len(w) - 7) for e in index.get(tuple(w[i : i + 8]), ())}
    got = leaks.leaked_passages(docs, items).filter("shares_run").collect()
    assert {(r["doc_id"], r["eval_id"]) for r in got} == want


def test_words():
    assert leaks.words_of("Crème­Brûlée—l'été ２nd ") == ["cremebrulee", "l", "ete", "２nd"]
    assert leaks.words_of(None) == [] == leaks.words_of("… !")


def test_declared_names(spark):
    names = ["en", "en-GB", "EN_us", "eng", "English", "Deutsch", "jpn", "pt-BR", "", " ", "xx", "und", None, "pl", "Français"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(language.declared_language(__import__("pyspark").sql.functions.col("n"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", "ja", "pt", None, None, None, None, None, "pl", "fr"]


def test_held_out_accuracy(spark, sf):
    pdf = spark.read.parquet(f"{sf}/lang_samples.parquet").toPandas()
    test = pdf.sample_no % 3 == 0
    m = language.LanguageModel.fit(list(pdf[~test].sample_text), list(pdf[~test].lang))
    got = np.array(m.langs)[m.scores(list(pdf[test].sample_text)).argmax(1)]
    assert (got == pdf[test].lang.to_numpy()).mean() >= 0.99


def test_lines_and_segments(spark, sf):
    samples = spark.read.parquet(f"{sf}/lang_samples.parquet")
    fr, en = "Le pêcheur peignit le registre bleu puisque la clé manquait.", "The old teacher opened the village map although it was raining hard."
    rows = [(1, f"{fr}\n{en}\n\n123 !", "fr", "a-x"), (2, None, "fr", None), (3, "", None, "a-x"), (4, f"{en} {en} {fr}", None, "b-x"), (5, "…", "en", "b-x"), (6, (en + " ") * 3000, "German", "a-x"), (1, "正午に、老いた教師が空の樽を塗装した。", "ja", "c")]
    lines = language.identify_languages(_docs(spark, rows), samples).toPandas()
    got = {(r.doc_id, r.line_no, r.lang) for r in lines.itertuples()}
    assert got == {(1, 0, "fr"), (1, 1, "en"), (4, 0, "en"), (6, 0, "en"), (1, 0, "ja")}
    assert lines.confidence.between(0.5, 1.0).all()
    four = lines[lines.doc_id == 4].iloc[0]
    assert [s["lang"] for s in four.segments] == ["en", "en", "fr"] and four.confidence < 0.9
    docs = {r["doc_id"]: (r["lang"], r["n_languages"]) for r in language.document_languages(language.identify_languages(_docs(spark, rows), samples)).collect()}
    assert docs[4] == ("en", 2) and docs[6] == ("en", 1)
    assert language.identify_languages(_docs(spark, []), samples).count() == 0
    with pytest.raises(ValueError):
        language.fit_samples(samples.limit(0))
