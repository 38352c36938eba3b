"""Documents with every odd case, and brute-force helpers."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row string, id__ int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def doc(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), 7, "k", "r", 1)


def odd_documents():
    long = " ".join(f"w{k % 701}x{k % 89}" for k in range(9000))
    prose = "The quick brown fox jumps over the lazy dog while seven wizards brew potions in the cold morning light.\nA second line follows here with more words."
    return [
        doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(4, "one"), doc(5, "Two words"), doc(6, long), doc(7, prose, None),
        doc(8, prose, "a"), doc(8, prose, "a"), doc(9, prose.upper(), "a"), doc(10, prose.replace("seven", "eight"), "b"),
        doc(None, "no id at all but some words in it", "b"), doc(11, "é ü 日本 😀\x00 ▁ <|endoftext|>  x\r\n y z", "é"), doc(12, "a b c d e " * 30, "b"),
        doc(13, "same\nsame\n same\nother 1\n", "b"), doc(14, "x" * 3000, "c"),
    ]


def odd_table(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")
