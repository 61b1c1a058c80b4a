import random
import unicodedata

from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import intent as I
from clausespark.functions import lang as L
from clausespark.functions import numeric as N
from clausespark.functions import refs as R
from clausespark.functions import text as X


def stem_loop(word):
    while True:
        for s in K.SUFFIXES:
            if word.endswith(s) and len(word) - len(s) >= 4:
                word = word[: -len(s)]
                break
        else:
            return word


def test_stems_match_the_loop(spark):
    rng = random.Random(7)
    parts = list(K.SUFFIXES) + ["bino", "hoja", "x", "ko'p", "д"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["abcd" + "i" * 40, "hojatxonasidan", "binosigacha"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem_text("w").alias("s"))
    assert all(r["s"] == stem_loop(r["w"]) for r in df.collect())


def test_known_stems(one):
    assert one(X.stem_text(F.lit("hojatxonasidan"))) == "hojatxona"
    assert one(X.stem_text(F.lit("binosigacha"))) == "bino"


def repair_loop(value):
    import re

    a, b = re.compile(K.CLASSIC_MOJIBAKE), re.compile(K.APOSTROPHE_MOJIBAKE)
    count = lambda t: len(a.findall(t)) + len(b.findall(t))
    if not (a.search(value) or b.search(value)):
        return value
    fixed = value.encode("cp1251", "ignore").decode("utf-8", "ignore")
    ok = fixed and count(fixed) <= count(value) and len(fixed) >= int(len(value) * 0.75)
    return fixed if ok else value


def test_mojibake_repair_matches_codec(spark):
    good = ["oʻlchov gʻisht", "Привет мир", "ko‘cha", "plain", "é à ü", "ёлка ъ"]
    bad = [g.encode("utf-8").decode("cp1251", "ignore") for g in good]
    rows = good + bad + [g + " " + b for g, b in zip(good, bad)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select("t", X.repair_mojibake("t").alias("r"), X.to_mojibake("t").alias("m")).collect()
    for r in out:
        assert r["r"] == repair_loop(r["t"])
        assert r["m"] == r["t"].strip().encode("utf-8").decode("cp1251", "ignore")


def test_compat_normalisation(spark):
    rows = ["ﬁlm ½ m² №5", "plain", None, "café", "Ａｂｃ  d"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select("t", X.nfkc("t").alias("n"), X.normalize_text("t", compat=True).alias("q")).collect()
    for r in out:
        assert r["n"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"]))
    assert out[4]["q"] == "abc d"


def test_references(one):
    r = one(R.exact_refs(F.lit("SHNQ 2.07.01-23 bo'yicha 3.17 band va 9-jadval, 2-ilova, 4-bob")))
    assert r["document_codes"] == ["SHNQ 2.07.01-23"]
    assert r["clause_numbers"] == ["3.17"]
    assert r["table_numbers"] == ["9"] and r["appendix_numbers"] == ["2"] and r["chapter_numbers"] == ["4"]
    assert one(R.label_title(F.lit("12-jadval. Material sarfi"))) == "Material sarfi"
    assert one(X.canonical_clause_number(F.lit("03,007"))) == "3.7"


def test_intents(one):
    kind = lambda t: one(I.classify(F.lit(t)))["intent"]
    assert kind("SHNQ 1.01.01-22 va SHNQ 2.07.01-23 farqini solishtir") == "compare_documents"
    assert kind("9-jadvalda nima berilgan") == "table_lookup"
    assert kind("3.2 band nima deydi") == "exact_band_reference"
    assert kind("yo'lak kengligi kamida necha metr bo'lishi kerak") == "topical_search"


def test_numeric(one):
    p = one(N.query_profile(F.lit("yo'lakning minimal kengligi qancha?")))
    assert p["is_numeric"] and p["comparator"] == "min"
    e = one(N.evidence(F.lit("5 mx emas, 0,8 m va 120 sm, 35% dan 40%li")))
    assert [(x["raw"], x["unit"]) for x in e] == [("0,8 m", "m"), ("120 sm", "cm"), ("40%", "%")]
    text = "5 mx emas, 0,8 m va 120 sm, 35% dan 40%li"
    assert all(text[x["start"] : x["end"]] == x["raw"] for x in e)
    m = one(N.match(N.query_profile(F.lit("minimal masofa qancha")), F.lit("masofa kamida 0,8 m bo'lishi kerak, eng ko'pi 3 m")))
    assert m["value"] == 0.8 and one(N.format_value(F.lit(m["value"]), F.lit(m["unit"]))) == "0,8 m"


def test_language(one):
    assert one(L.detect(F.lit("What is the minimum distance"))) == "en"
    assert one(L.detect(F.lit("Какое расстояние"))) == "ru"
    assert one(L.detect(F.lit("최소 거리는?"))) == "ko"
    assert one(L.detect(F.lit("yo'lak kengligi qancha"))) == "uz"


def test_answers(one):
    assert one(X.short_answer(F.lit("Batafsil: uzun matn. Qisqa qilib aytganda: 0,8 m."))) == "0,8 m."
    out = one(X.cleanup_answer(F.lit("(3) Javob: matn bor. (4) Xulosa: " + "a " * 20)))
    assert out.startswith("Batafsil: ") and out.endswith("a.") and len(out.split("aytganda: ")[1].split()) == 12
    assert one(X.json_salvage(F.lit('izoh {"a": 1} tamom'))) == '{"a": 1}'
    assert one(X.json_salvage(F.lit("yo'q"))) is None
