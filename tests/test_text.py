"""Text functions against golden values and plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cadenza.functions import distance, text


def apply(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {'double' if isinstance(values[0], float) else 'string'}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


NORMAL = {
    "334%": "ba trăm ba mươi bốn phần trăm", "Trong 40 năm tiếp theo.": "trong bốn mươi năm tiếp theo", "1.234.567": "một triệu hai trăm ba mươi bốn nghìn năm trăm sáu mươi bảy",
    "8h30": "tám giờ ba mươi", "8h": "tám giờ", "123h": "một hai mươi ba giờ", "3,5kg": "ba phẩy năm kg", "1000000000000": "1000000000000", "bốn mươi tư": "bốn mươi bốn", "0": "không",
    "15": "mười năm", "1005": "một nghìn không trăm lẻ năm", "1872": "một nghìn tám trăm bảy mươi hai", "10 km, 5g!": "mười ki lô mét năm gram", "a1b": "a một b", "": "", "  X  Y\t": "x y",
    "007": "bảy", "2,05": "hai phẩy không năm", "12h5": "mười hai giờ năm", "5kgs": "năm kgs", "ü ß ñ": "", "20 mm2": "hai mươi mm hai",
}


def test_normalize(spark):
    assert apply(spark, list(NORMAL), text.normalize) == list(NORMAL.values())
    assert apply(spark, ["334%", None, "Ă Ấ", "tư 12"], lambda c: text.normalize(c, False)) == ["334", "", "ă ấ", "tư 12"]


def test_nfc(spark):
    values = [unicodedata.normalize("NFD", "Việt Nam đường"), "plain", "é", "Å", "각"]
    assert apply(spark, values, text.nfc) == [unicodedata.normalize("NFC", v) for v in values]


def spelled(n):
    if n == 0:
        return text.DIGITS[0]
    groups = []
    while n:
        n, g = divmod(n, 1000)
        groups.append(g)
    out = [f"{text.below_thousand(g, k != len(groups) - 1)} {text.SCALES[k]}".strip() for k, g in reversed(list(enumerate(groups))) if g]
    return " ".join(out)


def test_number_words(spark):
    rng = random.Random(1)
    values = [*range(0, 130), 1000, 10**6, 10**9, 10**12 - 1, 100_000, 1_000_001, *(rng.randrange(10**rng.randrange(1, 12)) for _ in range(300))]
    assert apply(spark, [str(v) for v in values], text.number_words) == [spelled(v) for v in values]


def test_number_words_of_twelve_digits_and_more(spark):
    values = ["999999999999", "1000000000000", "0001000000000005", "7001002003004", "000000000000007", "0000000000000", None]
    assert apply(spark, values, text.number_words) == [spelled(10**12 - 1), *values[1:4], "bảy", "không", ""]
    said = ["", "không trăm lẻ năm", "không trăm lẻ một tỷ không trăm lẻ hai triệu không trăm lẻ ba nghìn không trăm lẻ bốn"]
    assert apply(spark, values, lambda c: text.number_words(c, last_twelve=True)) == [spelled(10**12 - 1), *said, "bảy", "không", ""]


def test_capitals_buckets_and_clock(spark):
    assert apply(spark, ["VÀ NẾU BẠN", "Xin Chào", "123", "", None, "ABCDe"], text.fold_capitals) == ["và nếu bạn", "Xin Chào", "123", "", None, "ABCDe"]
    assert apply(spark, [4.99, 5.0, 30.0, 30.1, 60.0, 60.1], text.bucket) == ["0-5", "5-30", "5-30", "30-60", "30-60", "60+"]
    assert apply(spark, [3661.5, 0.0, 59.9996, 0.0005, 0.0015], text.clock) == ["01:01:01.500", "00:00:00.000", "00:01:00.000", "00:00:00.000", "00:00:00.002"]
    assert apply(spark, ["Hi", "hi", " Ơ", "hi."], text.starts_with_capital) == [True, False, True, False]


def test_paths(spark):
    assert apply(spark, ["jellyfish1010_0041", "x", "a_b_1"], text.strip_index) == ["jellyfish1010", "x", "a_b"]
    assert apply(spark, ["278_000000086.wav", "", "abc.wav", None, "d/e/f_g.x.wav", ".wav"], text.path_channel) == ["278", "unknown", "abc", "unknown", "f", ".wav"]
    assert apply(spark, ["audio_502.22_504.3.wav", "x.wav", None, "d_9/a_1_2.flac"], text.path_start) == [502.22, 0.0, 0.0, 1.0]
    assert apply(spark, [None, "", "a_1", "b"], lambda c: text.column_channel(c, True)) == ["unknown", "unknown", "a", "b"]


def test_detokenize(spark):
    got = spark.range(1).select(text.detokenize(F.array(*map(F.lit, ["▁xin", "▁ch", "ào"]))).alias("x")).first()["x"]
    assert got == "xin chào"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choice(["một", "hai", "ba", "x"]) for _ in range(rng.randrange(9))), " ".join(rng.choice(["một", "hai", "ba", "y"]) for _ in range(rng.randrange(9)))) for _ in range(80)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, r string, h string")
    df = df.withColumns({"rw": distance.word_list(F.col("r")), "hw": distance.word_list(F.col("h"))})
    got = df.select("k", distance.word_edits("rw", "hw").alias("w"), distance.char_edits(F.col("r"), F.col("h")).alias("c")).orderBy("k").collect()
    assert [(r["w"], r["c"]) for r in got] == [(edits(a.split(), b.split()), edits(a, b)) for a, b in pairs]


@pytest.mark.parametrize("n", [0, 7, 10, 15, 20, 99, 100, 105, 110, 999])
def test_tables(n):
    assert text.below_thousand(n, True).split()[1] == "trăm"
    assert ("trăm" in text.below_thousand(n, False)) == (n >= 100)


def test_words_past_the_basic_plane_have_characters(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(35_049)), lambda k: F.concat(F.lit("w"), k.cast("string")))
    rows = spark.range(1).select(words.alias("words")).withColumn("tail", F.slice("words", 34_950, 101))
    got = rows.select(F.expr(distance.as_characters("tail", "array_position(words, w)"))).first()[0]
    assert len(set(got)) == len(got) == 101 and ord(got[0]) < 0xD800 and ord(got[-1]) > 0xFFFF
