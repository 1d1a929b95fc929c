"""Probabilities against the textbook formula, accuracy on rows that are never learned from, odd texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import columns as C
from larder.llm import language

SCHEMA = "doc_id long, text string, lang string, language string"


def plain(words):
    """Interpolated Kneser-Ney probability of a symbol after a context, by dictionaries."""
    n = language.ORDER
    marked = [["\x01", *w, "\x02"] for w, c in words.items() for _ in range(c)]
    grams = {k: Counter(tuple(m[i - k + 1 : i + 1]) for m in marked for i in range(1, len(m)) if i - k + 1 >= 0) for k in range(1, n + 1)}
    counts = {n: grams[n]}
    for k in range(n - 1, 0, -1):
        after = Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: c if g[0] == "\x01" else after[g] for g, c in grams[k].items()}
    total, kinds, discount = defaultdict(float), Counter(), {}
    for k in counts:
        for g, c in counts[k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        once, twice = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        discount[k] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    symbols = len({c for w in words for c in w}) + 2

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / symbols
        if not total[gram[:-1]]:
            return lower
        return max(counts[k].get(gram, 0) - discount[k], 0) / total[gram[:-1]] + discount[k] * kinds[gram[:-1]] / total[gram[:-1]] * lower

    return lambda w: sum(math.log2(p(tuple(["\x01", *w, "\x02"][max(0, i - n + 1) : i + 1]))) for i in range(1, len(w) + 2))


def test_probabilities():
    words = {"banana": 3, "band": 1, "an": 5, "nab": 2, "bandanas": 1, "é": 1}
    other = {"xyz": 2, "zzz": 1, "ban": 1}
    model = language.fit({"a": (list(words), np.array(list(words.values()), float)), "b": (list(other), np.array(list(other.values()), float))})
    split = language.Words()
    texts = ["banana", "xyz", "nabé bandan", "qqq", "an BAN"]
    symbols, bounds, which, first, length = split(*C.utf8(pa.array(texts)))
    bits = model.score(symbols, bounds, split.rolling)[which]
    letters = len(set("".join([*words, *other]))) + 2
    for i, text in enumerate(texts):
        assert length[which][first[i] : first[i + 1]].sum() == len(text.replace(" ", "")) + len(text.split())
        for column, source in enumerate((words, other)):
            ask = plain(source)
            if letters == len(set("".join(source))) + 2:
                want = sum(ask(w) for w in text.lower().split())
                assert bits[first[i] : first[i + 1], column].sum() == pytest.approx(want, rel=1e-4)
    only = language.fit({"a": (list(words), np.array(list(words.values()), float))})
    bits = only.score(symbols, bounds, split.rolling)[which]
    for i, text in enumerate(texts):
        assert bits[first[i] : first[i + 1], 0].sum() == pytest.approx(sum(map(plain(words), text.lower().split())), rel=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    tested = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.98 * len(tested)
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out)


def test_held_out_rows_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(str, language.identify(x).collect())) for x in (docs, changed))
    assert a == b


def test_odd_texts(spark):
    good = " ".join(["the quick brown fox jumps over the lazy dog and runs away"] * 3)
    other = " ".join(["le renard brun saute par dessus le chien paresseux et court"] * 3)
    rows = [(i, good if i % 2 else other, "en" if i % 2 else "fr", "") for i in range(400)]
    odd = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "12 34 !!", "en", ""), (1003, good * 3000, None, ""), (None, good, "zz", ""), (1004, "日本語のテキスト" * 20, None, ""), (1, good, "en", "")]
    out = language.identify(spark.createDataFrame(rows + odd, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows) + len(odd)
    found = {r["doc_id"]: r for r in out}
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[1003]["lang_pred"] == "en" and not found[1003]["rejected"]
    assert found[1004]["rejected"] and found[1004]["lang_pred"] in ("en", "fr")
    assert found[None]["lang_pred"] == "en" and not found[None]["held_out"]
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(400))


#: Frequent words of four languages that are learned and of two that are not.
COMMON = {
    "en": "the of and to in that was his with for had you not are but from they she which there been one all would were their have what about people",
    "fr": "les des que une dans pour qui pas sur plus par avec tout mais nous cette comme sont leur elle deux ainsi encore très peut être aussi sans",
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch werden aus hat dass sie nach wird bei einer noch wie über",
    "es": "que los del las por una para con no su al como más pero sus le ha me sin sobre este ya entre cuando todo esta ser dos también fue había",
}
STRANGE = {
    "nl": "het een zijn voor hij dat niet aan ook worden maar heeft naar door bij nog wel geen onze gisteren bekendgemaakt nieuwe maatregelen volgende maand",
    "pt": "não uma mais ele seu você foi são ela até isso então muito depois também seus quem já ontem anunciou novas medidas próximo mês governo",
}


def test_an_unlearned_language_of_a_known_script_is_rejected(spark):
    rng = np.random.default_rng(7)

    def text(words, n=25):
        return " ".join(rng.choice(words.split(), n))

    rows = [(i, text(COMMON[x], 20 + i % 60), x, "") for i, x in enumerate(list(COMMON) * 300)]
    # One labelled text of noise, and one of a single word, decide nothing.
    rows += [(9000, "qzx wvk jjq xkcd zzq " * 40, "es", ""), (9001, "Überlandleitungsmast " * 200, "de", "")]
    odd = {10_000 + i: text(STRANGE[x], n) for i, (x, n) in enumerate([("nl", 15), ("pt", 15), ("nl", 60), ("pt", 60), ("nl", 400)])}
    kept = {20_000: text(COMMON["en"], 15) + " " + text(COMMON["fr"], 15), 20_001: text(COMMON["de"], 8) + " " + text(COMMON["es"], 40), 20_002: text(COMMON["es"], 5)}
    docs = spark.createDataFrame(rows + [(i, t, None, "") for i, t in {**odd, **kept}.items()], SCHEMA)
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [i for i in odd if not found[i]["rejected"]] == []
    assert [i for i in kept if found[i]["rejected"]] == []
    assert sum(found[r[0]]["rejected"] for r in rows[:-2]) == 0


def test_columns_of_any_name_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"language": F.lit("mine"), "rejected": F.lit(1)})
    kept = language.in_known_languages(docs, language.learn(docs))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter(F.col("text").rlike(r"\p{L}")).collect()))


def test_nothing_to_learn_from(spark):
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    out = language.identify(spark.createDataFrame([(1, "words", None, "")], SCHEMA)).collect()
    assert (out[0]["lang_pred"], out[0]["rejected"]) == ("und", True)
