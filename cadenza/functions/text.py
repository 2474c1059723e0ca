"""Text functions as Column expressions; only NFC of unusual texts leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that scoring keeps, number words, units and spoken variants.
DIACRITICS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
HUNDRED, TENS, TEEN, ODD = "trăm", "mươi", "mười", "lẻ"
SCALES = ("", "nghìn", "triệu", "tỷ")
UNITS = {
    "%": "phần trăm", "kg": "ki lô gam", "km": "ki lô mét", "cm": "xăng ti mét", "mm": "mi li mét", "ml": "mi li lít",
    "gr": "gram", "g": "gram", "m": "mét", "l": "lít",
}
VARIANTS = {"tư": "bốn", "mốt": "một", "lăm": "năm", "ngàn": "nghìn", "linh": "lẻ"}
HOUR, POINT = "giờ", "phẩy"

_LETTER = f"[0-9a-z{DIACRITICS}]"
#: Private marks around digits that an earlier rule has claimed, and before digits to be read one by one.
_OPEN, _CLOSE, _EACH = "\ue010", "\ue011", "\ue012"
#: Texts of these characters only are in NFC as they are.
_NFC_SAFE = r"^[\x{0}-\x{2FF}\x{1E00}-\x{1EFF}\x{2002}-\x{2125}]*$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC; only texts that may not be in it go through Python."""
    return F.coalesce(_nfc(F.when(~text.rlike(_NFC_SAFE), text)), text)


def below_thousand(n: int, full: bool) -> str:
    """0 to 999 in words; full reads the hundreds even where there are none. 0 is empty unless full."""
    words = [DIGITS[n // 100], HUNDRED] if full or n >= 100 else []
    tens, units = n // 10 % 10, n % 10
    words += [] if tens == 0 else [TEEN] if tens == 1 else [DIGITS[tens], TENS]
    if units:
        words += ([ODD] if words and tens == 0 else []) + [DIGITS[units]]
    return " ".join(words)


def _table(full: bool) -> Column:
    return F.split(F.lit("|".join(below_thousand(n, full) for n in range(1000))), r"\|")


def number_words(digits: Column, last_twelve: bool = False) -> Column:
    """Digits (a string) of a number below 10^12 in words; of larger ones, the digits as they are.

    With last_twelve, larger ones are read too, by their last twelve digits with all hundreds. Null is empty.
    """
    bare = F.regexp_replace(digits, "^0+", "")
    padded = F.substring(F.concat(F.lit("0" * 12), bare), -12, 12)
    part = lambda k: F.substring(padded, 10 - 3 * k, 3).cast("int")  # noqa: E731  group k, from the units up
    out = []
    for k in (3, 2, 1, 0):
        first = F.length(bare) <= 3 * k + 3
        words = F.when(first, F.get(_table(False), part(k))).otherwise(F.get(_table(True), part(k)))
        scaled = F.concat(words, F.lit(f" {SCALES[k]}")) if SCALES[k] else words
        out.append(F.when((part(k) > 0) & (F.length(bare) > 3 * k), scaled))
    said = F.concat_ws(" ", *out)
    words = F.when(bare == "", DIGITS[0]).otherwise(said)
    return words if last_twelve else F.when(F.length(bare) > 12, digits).otherwise(words)


def digit_words(digits: Column) -> Column:
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.get(F.array(*map(F.lit, DIGITS)), d.cast("int"))), " ")


def _fold(word: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, word), word)


def fold_variants(word: Column) -> Column:
    return _fold(word, VARIANTS)


def unit_words(unit: Column) -> Column:
    return _fold(unit, UNITS)


def _marked(text: Column) -> Column:
    """Numbers set apart as words of their own: plain digits, or _EACH and digits."""
    t = F.regexp_replace(text, r"(?<=[0-9])\.(?=[0-9]{3}(?![0-9]))", "")
    t = F.regexp_replace(t, rf"([0-9]{{1,2}})h([0-9]{{1,2}})(?!{_LETTER})", f" {_OPEN}$1{_CLOSE} {HOUR} {_OPEN}$2{_CLOSE}")
    t = F.regexp_replace(t, rf"([0-9]{{1,2}})h(?!{_LETTER})", f" {_OPEN}$1{_CLOSE} {HOUR} ")
    t = F.regexp_replace(t, "([0-9]+),([0-9]+)", f" {_OPEN}$1{_CLOSE} {POINT} {_EACH}$2{_EACH} ")
    for unit, words in sorted(UNITS.items(), key=lambda u: -len(u[0])):
        t = F.regexp_replace(t, rf"([0-9]+)\s*{unit}(?!{_LETTER})", f" {_OPEN}$1{_CLOSE} {words} ")
    t = F.regexp_replace(t, f"(?<![0-9{_OPEN}{_EACH}])(0*[0-9]{{1,12}})(?![0-9{_CLOSE}{_EACH}])", " $1 ")
    t = F.regexp_replace(t, f"{_EACH}([0-9]+){_EACH}", f" {_EACH}$1 ")
    return F.regexp_replace(t, f"[{_OPEN}{_CLOSE}]", " ")


def spoken_numbers(text: Column) -> Column:
    """Digits of a lower-case text as words: thousands points go, then clock times, decimals, units, whole numbers.

    Numbers of 10^12 and more stay digits, also before a unit, in a clock time or a decimal.
    """
    words = F.split(_marked(text), r"(?U)\s+")
    said = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), number_words(w)).when(w.startswith(_EACH), digit_words(F.substr(w, F.lit(2)))).otherwise(w))
    return F.when(text.rlike("[0-9]"), F.array_join(said, " ")).otherwise(text)


def normalize(text: Column, expand_numbers: bool = True) -> Column:
    """The scoring form: NFC, lower case, numbers spoken, only kept letters, single spaces, variants folded. Null is empty.

    Without expand_numbers, digits stay and variants are not folded (the older form).
    """
    t = F.lower(nfc(F.coalesce(text, F.lit(""))))
    t = spoken_numbers(t) if expand_numbers else t
    t = F.regexp_replace(t, rf"(?U)[^a-z0-9\s{DIACRITICS}]", " ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    if not expand_numbers:
        return t
    return F.array_join(F.transform(F.split(t, " "), fold_variants), " ")


def fold_capitals(text: Column, share: float = 0.8) -> Column:
    """Texts of which more than `share` of the letters are capitals, in lower case; others as they are."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when((letters > 0) & (F.regexp_count(text, F.lit(r"\p{Lu}")) / letters > share), F.lower(text)).otherwise(text)


def detokenize(pieces: Column) -> Column:
    """Pieces with ▁ for word starts to a text."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" ")))


def clock(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm, half milliseconds to even; mark "," for subtitles."""
    ms = F.bround(seconds * 1000).cast("long")
    whole = lambda unit, top=None: (F.floor(ms / unit) % top if top else F.floor(ms / unit)).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", whole(3_600_000), whole(60_000, 60), whole(1000, 60), (ms % 1000).cast("int"))


def has_digits(text: Column) -> Column:
    return text.rlike("(?U)\\d")


def has_punctuation(text: Column) -> Column:
    return text.rlike("[.,?!]")


def starts_with_capital(text: Column) -> Column:
    return text.rlike(r"^(?U:\s)*[A-ZÀ-Ỹ]")


def bucket(seconds: Column) -> Column:
    """Duration bucket: below 5, to 30, to 60, and above."""
    return F.when(seconds < 5, "0-5").when(seconds <= 30, "5-30").when(seconds <= 60, "30-60").otherwise("60+")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_index(value: Column) -> Column:
    """Without a trailing _<index>; as it is without an underscore."""
    return F.regexp_replace(value, "_[^_]*$", "")


def path_channel(path: Column) -> Column:
    """The recording that a file name belongs to: the stem without its last _part; `unknown` without a name."""
    name = base_name(path)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.when(path.isNull() | (path == "") | (stem == ""), "unknown").otherwise(strip_index(stem))


def column_channel(value: Column, strip: bool = False) -> Column:
    """A channel column as a grouping key: null and empty are one channel, `unknown`."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(strip_index(text) if strip else text)


def path_start(path: Column) -> Column:
    """Seconds in names such as audio_502.22_504.3.wav; else 0."""
    found = F.regexp_extract(F.coalesce(base_name(path), F.lit("")), r"_([0-9]+(?:\.[0-9]+)?)_[0-9]+(?:\.[0-9]+)?\.\w+$", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))
