"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import byte_bpe, language, quality, secret_scan, simhash, token_files, toxicity
from wardline.llm.components import components
from wardline.llm.decontaminate import decontaminate
from wardline.llm.line_dedup import dedup_lines
from wardline.llm.queries import QUERIES
from wardline.llm import search
from wardline.llm.search import bm25

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"w{i} of a very long text" for i in range(6000))
PASSAGE = "one two three four five six seven eight nine ten"
ROWS = [
    (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, LONG, "en", None, 1), (4, LONG, "en", "s", None),
    (5, "Hello there, general words. " * 3, "en", "s", 5), (5, "Hello there, general words. " * 3, "en", "s", 5),
    (None, "a text without an id", "de", "s", 1), (7, "before " + PASSAGE + " after", "en", "s", 1),
    (8, "short", "en", "s", 5), (9, " \n\t\n \n", "fr", "s", 5), (10, "é ü 日本語 𝄞", "de", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Two folders of tables: the rows above, and nothing."""
    path = tmp_path_factory.mktemp("tables")
    for name, data in (("full", docs), ("none", docs.limit(0))):
        data.write.parquet(f"{path}/{name}/documents.parquet")
        ids = data.where("doc_id is not null")
        ids.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")).write.parquet(f"{path}/{name}/labels.parquet")
        items = spark.createDataFrame([(1, PASSAGE), (2, "short"), (3, None), (None, "hello there"), (5, "")], "item_id long, text string")
        (items if name == "full" else items.limit(0)).write.parquet(f"{path}/{name}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(QUERIES))
@pytest.mark.parametrize("kind", ["full", "none"])
def test_runs_on_odd_tables(spark, folder, name, kind):
    n = QUERIES[name](spark, f"{folder}/{kind}").count()
    assert n == 0 if kind == "none" or name == "op2_search" else n > 0  # no id here is a query's
    if kind == "full" and name not in ("pipeline", "op2_search", "op11_filter_audit", "op12_packing"):  # rows of other things
        assert n == len(ROWS) - (name == "op1_decontamination")  # there, equal rows give one


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, "Short"), (3, None), (None, "hello there")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert (got[7].n_words, got[7].n_hit, got[7].items) == (12, 10, ["1"])
    assert (got[8].n_words, got[8].n_hit, got[8].items) == (1, 1, ["2"])
    assert got[1].n_words == got[2].n_words == 0 and not got[5].contaminated


def test_line_dedup_keeps_the_first_and_other_columns(spark):
    rows = [(1, "a\nb\nc\nd", 9), (2, "x\na\nb\nc\nd\ny", 8), (3, "a\nb", 7), (4, None, 6)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, version long")
                      .withColumnRenamed("version", "covered")).orderBy("doc_id").collect()
    assert [(r.text, r.covered, r.n_removed) for r in got] == [("a\nb\nc\nd", 9, 0), ("x\ny", 8, 4), ("a\nb", 7, 0), (None, 6, 0)]


def test_line_dedup_with_names_of_its_own(spark):
    rows = [(1, "a\nb\nc", 9, 8), (2, "a\nb\nc", 7, 6)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed long, n_lines long")).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "n_removed", "n_lines", "n_lines_", "n_removed_"]
    assert [tuple(r)[1:] for r in got.collect()] == [("a\nb\nc", 9, 8, 3, 0), ("", 7, 6, 3, 3)]


def test_line_dedup_of_a_text_of_many_repeated_lines(spark):
    """Seconds grow with the lines, not with their square."""
    import time

    def seconds(n):
        text = "\n".join(f"line {i % 50}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = dedup_lines(docs).collect()
        assert (row.n_lines, row.n_removed, row.text) == (n, n - 50, text[:len("\n".join(f"line {i}" for i in range(50)))])
        return time.perf_counter() - began
    seconds(2000)
    assert seconds(80_000) < 3 * max(seconds(40_000), 1)


def test_language_learns_nothing_from_texts_held_out(spark):
    rows = [(i, f"the house of {i} lords" if i % 2 else f"das haus und {i} garten", "en" if i % 2 else "de") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = ~language.held_out()
    other = docs.withColumn("text", F.when(usable, F.col("text")).otherwise(F.lit("quite another text of zebras")))
    unnamed = spark.createDataFrame([(1000 + i, "no language is given here", None) for i in range(50)], docs.schema)
    one, two = (language.fit(d, usable) for d in (docs, other.unionByName(unnamed)))
    assert (one.weights == two.weights).all() and (one.bias == two.bias).all() and one.temperature == two.temperature


def test_one_of_each_keeps_one_of_repeated_rows(docs):
    got = simhash.one_of_each(docs.withColumn("fp", F.lit("own"))).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(5) == 1 and 3 in ids and 4 not in ids and 1 in ids and 2 not in ids


def test_large_files_are_dealt_into_blocks(spark):
    """A hot file gives the same components as plain search does."""
    fps = [sum(1 << b for b in (i % 64, i // 64 % 64, i // 4096 * 7 % 64)) for i in range(900)] + [(1 << 62) - 1, (1 << 62) - 2]
    df = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in set(fps)], "fp long")
    for size in (16, 4096):
        got = components(simhash.links(df, size))
        assert sorted(n for (n,) in got.groupBy("label").count().select("count").collect()) == [2, len(set(fps)) - 2]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0) for i in range(41)}


def test_search_of_an_empty_query(docs):
    got = bm25(docs.where("doc_id is not null"), F.col("doc_id") <= 2)
    assert got.count() == 0


def test_search_takes_document_counts_from_the_index(spark):
    """Counts and mean length come from the postings of all shards; null and empty texts count as documents."""
    texts = ["a b b", "b c", None, "", "a b", "c c c c"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = docs.select("doc_id", F.when(F.length("text") > 0, F.split("text", " ")).otherwise(F.array().cast("array<string>")).alias("w"))
    terms = words.select("doc_id", F.size("w").cast("int").alias("n"), F.transform("w", lambda w: F.xxhash64(w)).alias("terms"))
    shards = search.index_shards(terms, len(texts), shard=5)
    with search.one_row_batches(spark):
        got = {r["term"]: r["df"] for r in search.document_counts(shards).collect()}
        assert abs(search.mean_length_of(shards) - 11 / 6) < 1e-12
        assert search.mean_length_of(shards.limit(0)) == 1.0
    named = {r["w"]: r["h"] for r in words.select(F.explode("w").alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    assert got == {named["a"]: 6, named["b"]: 9, named["c"]: 6}
    held = [(t or "").split() for t in texts]
    part = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in (("a", 6), ("b", 9))}
    want = sorted((-round(sum(part[w] * 2.2 * d.count(w) / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / (11 / 6))) for w in "ab"), 6), i)
                  for i, d in enumerate(held))[:10]
    found = sorted((r["rank"], r["doc_id"], r["score"]) for r in bm25(docs, F.col("doc_id") == 0).collect())
    assert [i for _, i, _ in found] == [i for s, i in want if s] and np.allclose([s for *_, s in found], [-s for s, _ in want if s])


def test_search_opens_nothing_below_a_floor(monkeypatch):
    """A floor from other shards leaves out lower scores only: equal ones stay, and blocks below it are not opened."""
    terms = [np.array([1]), np.array([1, 2]), np.array([3])] * 50
    flat = np.concatenate(terms)
    index = search.opened(search.build_index(np.arange(150), np.array([len(t) for t in terms]), np.array([len(t) for t in terms]),
                                             flat, np.ones(len(flat), int)), 4 / 3)
    ids, scores = search.search(index, np.array([2]), np.array([1.0]), 3)
    assert list(ids) == [1, 4, 7]
    same, _ = search.search(index, np.array([2]), np.array([1.0]), 3, least=scores[2])
    assert list(same) == [1, 4, 7]
    opened = []
    spans = search.spans
    monkeypatch.setattr(search, "spans", lambda *a: opened.append(1) or spans(*a))
    none, _ = search.search(index, np.array([2]), np.array([1.0]), 3, least=scores[0] + 1)
    assert len(none) == 0 and len(opened) == 1  # the segments for the bounds, no postings


@pytest.mark.parametrize("shard", [3, 50])
def test_search_is_the_same_over_any_number_of_shards(spark, monkeypatch, shard):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.concat(F.lit("w"), ((F.col("id") * k) % (5 + k)).cast("string")) for k in range(1, 7)]).alias("text"))
    asks = F.col("doc_id") % 20 == 0
    want = sorted(map(tuple, bm25(docs, asks).collect()))
    build = search.index_shards
    monkeypatch.setattr(search, "index_shards", lambda rows, n: build(rows, n, shard))
    assert sorted(map(tuple, bm25(docs, asks).collect())) == want and len(want) == 100


def test_token_blocks_with_outliers():
    import numpy as np
    ids = np.array([5] * 200 + [2 ** 32 - 1, 0, 77], np.uint32)
    data = token_files.encode_segment(ids, np.array([100, 0, 103]))
    assert (token_files.decode_segment(data)[0] == ids).all() and (token_files.read_ids(data, 199, 3) == ids[199:202]).all()
    with pytest.raises(ValueError):
        token_files.decode_segment(b"xxxx" + data[4:])


def test_streaming_decode_and_transducer():
    import public_tokenizers
    encoder, decoder = byte_bpe.coders(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("", "日本語 𝄞😀 don't", "a  b\n\n c" + "x" * 300, "Ünïcödé " * 20):
        ids = encoder.encode(text)
        assert "".join(decoder.stream([i] for i in ids)) == text
        assert [t for s in encoder.pattern.findall(text) for p in encoder.transducer.stream(s.encode()) for t in p] == ids
    assert not decoder.sound(decoder_ids(encoder, b"\xff\xfe"))


def decoder_ids(encoder, data):
    import numpy as np
    return np.array([encoder.ranks[bytes((b,))] for b in data])


def test_secret_checksums_and_offsets():
    body = "a1B2" * 7 + "zz"
    token = f"ghp_{body}{secret_scan.checksum(body.encode()).decode()}"
    text = f"é {token} x ghp_{body}000000 PassWord: 'abcdefghijkl' token=secret:abcdefghijklmnop AKIA{'A' * 14}"
    kinds = [(k, text[a:b]) for a, b, k in secret_scan.Scanner().spans(text)]
    assert kinds == [("github", token), ("assign", "PassWord: 'abcdefghijkl"), ("access", "AKIA" + "A" * 14)]


def test_toxicity_tolerates_gaps():
    clean = ["house", "table", "window", "garden", "river", "mountain", "idea", "lemon", "motor", "idle", "patio"] * 3
    model = toxicity.fit_words(["idiot", "moron", "pathetic"], clean)
    plain, gapped, inserted, other = model.decide(["idiot", "i.d.i.o.t", "idi0t", "garden"])
    assert min(plain, gapped, inserted) > 0 > other


def test_toxicity_gaps_and_letters_of_all_scripts():
    def cosine(a, b):
        x, y = toxicity.word_vectors([a, b])
        return float(x @ y)

    for sign in ".", "-", "\u200b", "\u2014", "\u2022", "\ufeff":
        assert cosine("idiot", sign.join("idiot")) > 0.9
    assert cosine("придурок", "\u200b".join("придурок")) > 0.9
    for clean in "хорошими", "лопатами", "зеркалом":  # no letters in common places
        assert cosine("придурок", clean) < 0.1
    assert cosine("crétin", "cròtùn") < cosine("crétin", "crétins") - 0.3
    model = toxicity.fit_words(["придурок", "сволочь"], ["хорошими", "лопатами", "зеркалом", "привет", "урок", "garden"] * 3)
    assert min(model.decide(["придурок", "\u2022".join("придурок")])) > 0 > max(model.decide(["урок", "хорошими"]))


def test_toxicity_telling_words_by_significance(spark):
    """Counts are of documents: relative to their number, copies once, a fixed phrase like any other word."""
    assert set(toxicity.telling_counts([(4, 0, 1), (1, 0, 2000), (9, 60, 5)], 9, 60)) == {(4, 0)}  # one document proves nothing
    assert not toxicity.telling_counts([(6, 0, 3), (4, 4, 3000)], 2000, 2000)
    rows = [(i, f"house{i} you utter moron garden{i} river{i * 7}") for i in range(12)]
    rows += [(20 + i, "garden window lamprey table noise of one copied passage") for i in range(8)]
    rows += [(100 + i, f"house{i} you garden{i} window table{i} of noise river{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r.word: r.n for r in toxicity._documents_of(toxicity._words(docs.where("doc_id < 100")), "n").collect()}
    assert counts["moron"] == counts["utter"] == 12 and counts["lamprey"] == 1
    model = toxicity.fit(docs, docs.select("doc_id", F.expr("cast(doc_id < 100 as int)").alias("toxic")), F.lit(True))
    moron, lamprey, garden = model.decide(["moron", "lamprey", "garden"])
    assert moron > 0 > max(lamprey, garden)


def test_language_without_letters():
    import numpy as np
    rows = [(lang, *(x.astype(float) if i else x for i, x in enumerate(np.unique(language.grams(t), return_counts=True))))
            for lang, t in (("en", "the house of the lord"), ("de", "das haus und der garten")) for _ in range(10)]
    model = language.fit_rows(rows, np.ones(language.BUCKETS))
    assert model.predict(None) == model.predict("12 !!") == ("und", 0.0)
    assert model.predict("the lord")[0] == "en" and model.predict("das haus " * 60_000)[0] == "de"


def test_language_learns_every_language(spark, monkeypatch):
    """More languages than the 200 of an earlier limit; the sample of each is the least by hash."""
    monkeypatch.setattr(language, "SAMPLE", 4)
    rows = [(1000 * k + i, f"text {chr(0x4E00 + k) * 5} {i}", f"l{k:03}") for k in range(206) for i in range(9 if k < 200 else 3)]
    rows += [(1000 * k + i, None, f"l{k:03}") for k in range(206) for i in range(400, 402)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit_rows", lambda rows, idf: seen.extend(rows))
    language.fit(docs, F.lit(True))
    counts = {k: sum(r[0] == k for r in seen) for k in {r[0] for r in seen}}
    assert len(counts) == 206 and counts["l000"] == 4 and counts["l205"] == 3


def test_quality_prior_and_empty_training():
    import numpy as np
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.2, 0.05, (8000, 15)), rng.normal(0.7, 0.05, (2000, 15))
    model = quality.fit_rows(good[:4000], np.concatenate((good[4000:], bad)))
    assert 0.5 < model.prior < 0.8 and model.score(good).min() > quality.THRESHOLD > model.score(bad).max()
    assert quality.fit_rows(good[:0], bad).score(good).tolist() == [0.5] * 8000


def test_pipeline_stages_keep_columns(spark, docs, folder):
    named = docs.withColumns({c: F.lit(i) for i, c in enumerate((
        "score", "version", "row", "n_lines", "n_removed", "covered", "key", "lines", "fp", "root", "component_id", "words", "item"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, named, f"{folder}/full").columns == named.columns
