"""Small tables with everything that real ones may hold."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, digest string, fp long, key string, k int, leaked boolean, lang_pred string, score double, bucket string, start long, ids string"

#: Null and empty texts, one letter, white space only, odd white space, control strings,
#: accents, other scripts, emoji, surrogate-range neighbours, long words, repeats, a long text.
TEXTS = [
    None,
    "",
    "a",
    " \n\t ",
    "two  spaces\n\n and\r\nlines ",
    "it's 12345 <|endoftext|> and <|im_end|> now",
    "Éàü ñ ß Œ naïve café",
    "Привет мир, это текст",
    "漢字かな交じり文",
    "emoji 😀😀 and ́combining",
    "x" * 3000,
    "same words same words same words same words",
    "same words same words same words same words",
    "nul\x00byte \x1c sep \x85 nel \xa0nbsp",
    ("The quick brown fox jumps over the lazy dog. " * 40 + "\n") * 30,
]


def documents(spark, texts=None, first: int = 10):
    texts = TEXTS if texts is None else texts
    made = [(first + i, t, "en" if i % 2 else None, None if i % 3 else "s", None, 1, "d", 2, "k", 3, True, "xx", 0.5, "b", 4, "i") for i, t in enumerate(texts)]
    made.append((first, texts[0] if texts else None, *made[0][2:]) if made else (None, None, *[None] * 14))  # a repeated row
    made.append((None, "a row without an id", *[None] * 14))
    return spark.createDataFrame(made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
