"""The secret scan on texts of a megabyte and more."""

import random
import time

import plain
import pytest

from numweave.llm import secrets


def scan(spark, text):
    return secrets.digest(secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()


LONG = "".join(random.Random(1).choices(secrets.ALPHABET, k=1_000_000))
CASES = {
    "path": ("a-" * 500_000 + "1", 0),
    "broken path": ("a-" * 3000 + "1!", 0),
    "path with a digit inside": ("a1-" * 300_000, 0),
    "one run": (LONG, 1),
    "assignments": ("password = 'x12345' " * 100_000, 0),
    "assignments and candidates": (" ".join(f"token=abcdef{k} x7Gq9LmZ2kPw4RtY8v{k:06d}" for k in range(30_000)), 30_000),
    "hex runs": (" ".join(["0f9e8d7c" * 4] * 30_000), 0),
}


@pytest.mark.parametrize("name", CASES)
def test_long_texts(spark, name):
    text, added = CASES[name]
    began = time.time()
    got = scan(spark, text)
    assert time.time() - began < 60
    assert got.base_sha256 == plain.sha(plain.secrets(text))
    assert got.n_entropy == added


@pytest.mark.parametrize(
    ("text", "allowed"),
    [("usr/local/share/long_words/12", True), ("/usr/local/share-of-words/x1234", True), ("usr//local/share/of/words/12", False),
     ("usr/local/share/of/words/x12345", False), ("abcdefabcdefabcdefabcdef1234", False), ("a1b/usr/local/share/of/words", False)],
)
def test_paths_are_allowed(spark, text, allowed):
    import re

    from pyspark.sql import functions as F

    assert bool(re.fullmatch(r"/?(?:[A-Za-z]+[/_=-])+[A-Za-z]*[0-9]{0,4}", text)) == allowed
    found = spark.createDataFrame([(text,)], "t string").select(*(F.col("t").rlike(p) == F.lit(there) for p, there in secrets.PATHS)).first()
    assert all(found) == allowed


def test_candidates_beside_and_under_base_spans(spark):
    text = "x7Gq9LmZ2kPw4RtY8vBn3 secret=x7Gq9LmZ2kPw4RtY8vBn4 x7Gq9LmZ2kPw4RtY8vBn5"
    assert scan(spark, text).spans == "entropy:0:21,assign:22:50,entropy:51:72"
