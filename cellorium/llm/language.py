"""Language of documents and of their segments by fusing evidence.

Text likelihoods (character n-grams, trained on labelled samples) are combined by
Bayes' rule with the declared label and with a prior of the document's source,
smoothed towards the prior of sources with the same suffix and that towards all
sources.  The priors and the reliability of labels are grouped aggregations over
all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellorium.session import cut_lineage

#: Labelled samples read for training, n-gram orders, table size, additive smoothing.
MAX_SAMPLES, ORDERS, TABLE_BITS, SMOOTHING = 20_000, (1, 2, 3, 4, 5), 17, 0.3
#: n-grams of one text overlap, so their evidence counts by this share.
TEMPER = 0.25
#: Weight of the wider prior in rows, and of the label evidence.
STRENGTH, LABEL_WEIGHT = 20.0, 0.5
#: Sources with at least this part of all lines (one in HOT_SOURCES) are hot; there are HOT_SOURCES of them at most.
HOT_SOURCES = 1000
#: Share by which the other sentences of a line count for one that says little by itself.
CONTEXT = 0.05

#: Customary codes and names of each language beside its two-letter code.
NAMES = {
    "en": ("eng", "english", "anglais", "englisch", "inglés"),
    "de": ("ger", "deu", "german", "deutsch", "allemand", "alemán"),
    "fr": ("fre", "fra", "french", "français", "francais", "französisch", "francés"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "castilian", "spanisch", "espagnol"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch", "portugais"),
    "it": ("ita", "italian", "italiano", "italienisch", "italien"),
    "nl": ("dut", "nld", "dutch", "nederlands", "flemish", "vlaams", "niederländisch", "néerlandais"),
    "ru": ("rus", "russian", "русский", "russisch", "russe"),
    "ja": ("jpn", "japanese", "日本語", "japanisch", "japonais"),
}
#: Labels that name no language.
PLACEHOLDERS = ("", "xx", "xxx", "und", "unk", "unknown", "n/a", "na", "none", "null", "mul", "mis", "zxx", "-", "?")


def declared_language(c: Column) -> Column:
    """Two-letter code that a label names; null for null, empty and placeholder labels; unknown labels come out in lower case."""
    t = F.lower(F.trim(c))
    head = F.split(F.regexp_replace(t, "_", "-"), "-")[0]
    pairs = []
    for code, names in NAMES.items():
        for n in names:
            pairs += [F.lit(n), F.lit(code)]
    table = F.create_map(*pairs)
    named = F.coalesce(F.element_at(table, t), F.element_at(table, head), head)
    return F.when(t.isNull() | t.isin(*PLACEHOLDERS) | head.isin(*PLACEHOLDERS), F.lit(None)).otherwise(named)


_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}']+")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_SENTENCE = regex.compile(r"(?<=[.!?;:。！？…])\s*")


def clean(text: str) -> str:
    """Lower-case words of letters, with a blank at each end."""
    return " " + _NOT_LETTER.sub(" ", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower()).strip() + " "


def letters_in(text: str) -> int:
    return sum(map(str.isalpha, text))


def _grams(flat: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Table slot of the n-gram beginning at each position (the last n - 1 are padded with 0)."""
    pad = np.r_[flat, np.zeros(n - 1, np.uint32)].astype(np.uint64)
    h = np.full(len(flat), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ pad[j : j + len(flat)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class LanguageModel:
    """Naive Bayes over hashed character n-grams."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> "LanguageModel":
        langs = sorted(set(labels))
        counts = np.zeros((len(langs), len(ORDERS), 1 << TABLE_BITS), np.float64)
        for t, lab in zip(texts, labels):
            c = np.frombuffer(clean(t).encode("utf-32-le", "surrogatepass"), np.uint32)
            for o, n in enumerate(ORDERS):
                np.add.at(counts[langs.index(lab), o], _grams(c, n, TABLE_BITS)[: max(0, len(c) - n + 1)], 1)
        logs = []
        for o in range(len(ORDERS)):
            seen = max(1, int((counts[:, o].sum(0) > 0).sum()))
            tot = counts[:, o].sum(1, keepdims=True)
            logs.append(np.log((counts[:, o] + SMOOTHING) / (tot + SMOOTHING * seen)))
        table = np.stack(logs, 1).astype(np.float32)  # languages x orders x slots
        table -= table.mean(0, keepdims=True)
        return LanguageModel(langs, np.ascontiguousarray(table.transpose(1, 2, 0)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Tempered log-likelihood of each text in each language, up to a constant of the text."""
        k = len(self.langs)
        if not texts:
            return np.zeros((0, k))
        cs = [clean(t) for t in texts]
        lens = np.array([len(c) for c in cs])
        flat = np.frombuffer("".join(cs).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        left = np.repeat(starts + lens, lens) - np.arange(len(flat))
        total = np.zeros((len(texts), k))
        for o, n in enumerate(ORDERS):
            g = self.table[o][_grams(flat, n, TABLE_BITS)]
            g[left < n] = 0
            total += np.add.reduceat(g, starts, axis=0)
        return total * TEMPER


def fit_samples(samples: DataFrame, limit: int = MAX_SAMPLES) -> LanguageModel:
    """Train on at most ``limit`` labelled rows (lowest sample_no first); null texts and labels are left out."""
    rows = samples.filter(F.col("lang").isNotNull() & F.col("sample_text").isNotNull()).orderBy("sample_no").limit(limit).collect()
    if not rows:
        raise ValueError("no labelled samples to train on")
    return LanguageModel.fit([r["sample_text"] for r in rows], [r["lang"] for r in rows])


def score_lines(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", label: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, source, declared, line_no, n_letters, seg_letters, seg_scores): each line with letters, whole texts."""
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.langs)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                at, no, segs, of, letters = [], [], [], [], []
                for i, t in enumerate(part.column(3).to_pylist()):
                    for j, line in enumerate((t or "").split("\n")):
                        pieces = [(p, n) for p in _SENTENCE.split(line) if (n := letters_in(p))]
                        if pieces:
                            of += [len(at)] * len(pieces)
                            at.append(i)
                            no.append(j)
                            segs += [p for p, _ in pieces]
                            letters += [n for _, n in pieces]
                if not at:
                    continue
                sc = np.concatenate([m.scores(segs[x : x + 2000]) for x in range(0, len(segs), 2000)]).astype(np.float32)
                off = np.searchsorted(of, np.arange(len(at) + 1))
                seg_l = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(letters, pa.int32()))
                seg_s = pa.ListArray.from_arrays(pa.array(off * k, pa.int32()), pa.array(sc.ravel(), pa.float32()))
                idx = pa.array(at)
                tot = np.add.reduceat(np.array(letters), off[:-1])
                best = np.array([int(sc[off[i] : off[i + 1]].sum(0).argmax()) for i in range(len(at))], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), part.column(2).take(idx), pa.array(no, pa.int32()), pa.array(tot, pa.int64()), pa.array(best), seg_l, seg_s], names=["doc_id", "source", "declared", "line_no", "n_letters", "best", "seg_letters", "seg_scores"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), declared_language(F.col(label)).alias("declared"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, declared string, line_no int, n_letters long, best int, seg_letters array<int>, seg_scores array<float>")


def _counts(df: DataFrame, by: str | None, k: int) -> DataFrame:
    arr = F.array(*[F.coalesce(F.sum((F.col("best") == i).cast("double")), F.lit(0.0)) for i in range(k)])
    return df.groupBy(by).agg(arr.alias(f"n_{by}")) if by else df.agg(arr.alias("n_all"))


def identify_languages(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", source: str = "source") -> DataFrame:
    """Language of every line that has letters, with its segments.

    Columns: doc_id, line_no, lang, confidence, n_letters, declared, segments
    (array of lang, confidence, letters; one entry per sentence).  A line's
    language is the one most of its letters are in, ties by confidence.  Lines
    are split at ``\\n`` and numbered from 0; lines without letters, empty and null
    texts give no row.  A null source shares the prior of all sources.  Repeated
    doc ids are kept apart only by line_no.

    One pass scores all texts (the result, without texts, is kept in the shared
    folder); priors are aggregated per source, suffix and over all with map-side
    combine; the label table has a row per language and label and is bounded.
    """
    model = fit_samples(samples)
    langs, k = model.langs, len(model.langs)
    lines = cut_lineage(score_lines(docs, model, key, text, label, source)).withColumn("suffix", F.coalesce(F.element_at(F.split("source", "-"), -1), F.lit("")))
    everything = np.array(_counts(lines, None, k).first()["n_all"], float)
    base = (everything + 1.0) / (everything.sum() + k)
    known = F.when(F.col("declared").isin(langs), F.col("declared"))
    table = lines.filter(known.isNotNull()).groupBy(known.alias("d"), "best").agg(F.count(F.lit(1)).alias("n")).collect()
    conf = np.ones((k, k)) * 0.5 + 5.0 * np.eye(k)
    for r in table:
        conf[r["best"], langs.index(r["d"])] += r["n"]
    label_logs = np.log(conf / conf.sum(1, keepdims=True)) * LABEL_WEIGHT  # given the language, the label
    sources = _counts(lines.filter(F.col("source").isNotNull()), "source", k).withColumn("suffix", F.coalesce(F.element_at(F.split("source", "-"), -1), F.lit("")))
    suffixes = _counts(lines, "suffix", k)
    wide = F.array(*[F.lit(float(x)) for x in base])
    smooth = lambda n, prior: F.transform(F.zip_with(n, prior, lambda a, p: a + p * STRENGTH), lambda v: v / (F.aggregate(n, F.lit(0.0), lambda s, x: s + x) + STRENGTH))
    priors = sources.join(suffixes, "suffix").withColumn("by_suffix", smooth(F.col("n_suffix"), wide)).select(F.col("source").alias("p_source"), smooth(F.col("n_source"), F.col("by_suffix")).alias("prior"), F.aggregate("n_source", F.lit(0.0), lambda s, x: s + x).alias("n"))
    # sources with at least 1 / HOT_SOURCES of the lines, HOT_SOURCES at most, are broadcast; their lines and those without a source are spread over the join
    hot = priors.filter(F.col("n") * HOT_SOURCES >= float(everything.sum())).select(F.col("p_source").alias("h_source"), F.col("prior").alias("h_prior"))
    near = lines.join(F.broadcast(hot), F.col("source") == F.col("h_source"), "left")
    near = near.withColumn("part", F.when(F.col("source").isNull() | F.col("h_source").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).otherwise(0))
    key = F.coalesce("source", F.lit(""))
    met = near.join(priors.withColumn("salt", F.lit(0).cast("long")), (key == F.col("p_source")) & (F.col("part") == F.col("salt")), "left")
    joined = met.withColumn("prior", F.coalesce("h_prior", "prior")).select("doc_id", "line_no", "n_letters", "declared", "seg_letters", "seg_scores", F.coalesce("prior", wide).alias("prior"))
    kind = dict(joined.dtypes)["doc_id"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = b.column(4).offsets.to_numpy()
            off = off - off[0]
            letters = b.column(4).flatten().to_numpy(zero_copy_only=False)
            sc = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
            prior = np.log(b.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
            lab = np.array([label_logs[:, langs.index(d)] if d in langs else np.zeros(k) for d in b.column(3).to_pylist()])
            line_of = np.repeat(np.arange(b.num_rows), np.diff(off))
            line_sc = np.zeros((b.num_rows, k))
            np.add.at(line_sc, line_of, sc)
            z = sc + CONTEXT * (line_sc[line_of] - sc) + (prior + lab)[line_of]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            best = z.argmax(1)
            sure = z[np.arange(len(z)), best]
            weight = np.zeros((b.num_rows, k))
            np.add.at(weight, (line_of, best), letters + sure * 1e-3)
            lang = weight.argmax(1)
            share = np.bincount(line_of, weights=letters * z[np.arange(len(z)), lang[line_of]], minlength=b.num_rows) / np.bincount(line_of, weights=letters, minlength=b.num_rows)
            names = np.array(langs, dtype=object)
            seg = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(sure), pa.array(letters, pa.int32())], ["lang", "confidence", "letters"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[lang], pa.string()), pa.array(share), b.column(2), b.column(3), seg], names=["doc_id", "line_no", "lang", "confidence", "n_letters", "declared", "segments"])

    return joined.mapInArrow(fuse, f"doc_id {kind}, line_no int, lang string, confidence double, n_letters long, declared string, segments array<struct<lang:string,confidence:double,letters:int>>")


def document_languages(lines: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_languages): the language most letters of a document are in; ties by code.

    Documents without letters give no row.
    """
    s = lines.select("doc_id", F.explode("segments").alias("s"))
    per = s.groupBy("doc_id", F.col("s.lang").alias("lang")).agg(F.sum("s.letters").alias("letters"), F.sum(F.col("s.letters") * F.col("s.confidence")).alias("sure"))
    top = F.max(F.struct("letters", F.col("sure"), "lang")).alias("t")
    return per.groupBy("doc_id").agg(top, F.sum("letters").alias("n"), F.count(F.lit(1)).alias("n_languages")).select("doc_id", F.col("t.lang").alias("lang"), (F.col("t.sure") / F.col("n")).alias("confidence"), "n_languages")
