"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

LONG = "ab " * 40_000 + "x" * 30_000
ROWS = [
    (1, "The cat sat on the mat. The cat sat on the mat again.", "a"), (2, None, "a"), (3, "", None), (None, "no id here, but words", "a"), (5, LONG, "a"),
    (6, "same text twice over and over", "b"), (6, "same text twice over and over", "b"), (7, "same text twice over and over", "b"),
    (8, " \t\n ", "b"), (9, "ñé 中文 😀\u00a0x \x0b y\r\nz", "c"), (10, "one", "c"), (11, "a b c d e a b c d e a b c d e f", "c"),
    (12, "key\nkey\n\nkey \n other", "c"), (13, "BY!! ALL!! MEANS!! WE!! SHOUT!! ON!! AND!! ON!! NOW!! END!!", "c"), (14, "x | y | z | " * 30, "c"),
    (15, "one two three", "d"), (16, "one two three four", "d"), (17, "one two three four five", "d"),
]
SCHEMA = "doc_id long, text string, source string, _slot string, _bits string, _m string, _key string, _gone string, _id string, _clean string, _r string, _text string, _arrival string, payload_bytes string, feature string, pcm string, log_weight string, key string, copies string, p string, n_bytes string, id string, h string, ids string, media string, n_tokens string, kept string, _t string, fail_bits string, sketch string, w string, component_id string, rate string, spans string"


def frame(spark, rows=ROWS):
    extra = ["clash"] * (SCHEMA.count(",") - 2)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t, _ in ROWS]


def key(rows):
    return sorted(rows, key=repr)
