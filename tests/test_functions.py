"""Functions on given values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirthlake.functions import images
from mirthlake.functions import numeric as N
from mirthlake.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "image", "want"),
    [
        ("HTTPS://www.Example.com:443//a//b/?utm_source=x&b=2&a=1#top", False, "https://example.com/a/b?a=1&b=2"),
        ("https://example.com/a.png?width=20&v=3", True, "https://example.com/a.png?v=3"),
        ("https://example.com", False, "https://example.com/"),
        ("http://example.com:8080/x", False, "http://example.com:8080/x"),
        (" not a url ", False, "not a url"),
        ("", False, ""),
        (None, False, ""),
    ],
)
def test_canonical_url(spark, url, image, want):
    assert one(spark, T.canonical_url(F.col("u").cast("string"), image), u=url) == want


@pytest.mark.parametrize(("x", "want"), [("Tom &amp; Jerry &#39;x&#x27; &LT;&bogus;", "Tom & Jerry 'x' <&bogus;"), ("plain", "plain"), ("&#128512;", "😀"), ("&amp;amp;", "&amp;"), ("", "")])
def test_entities(spark, x, want):
    assert one(spark, T.decode_entities(F.col("x")), x=x) == want


def test_names(spark):
    assert one(spark, T.full_name(F.col("x")), x="Ça &amp; là – Ⅳ") == "ca la iv"
    assert one(spark, T.loose_key(F.col("x")), x="the woman yelling at a cat meme") == "at cat woman yelling"
    assert one(spark, T.loose_key(F.col("x")), x="a meme") is None
    assert one(spark, T.slug(F.col("x"), 8), x="  Hello, World again") == "hello-wo"
    assert one(spark, T.title_case(F.col("x")), x="de-la cruz's") == "De-La Cruz'S"
    assert one(spark, T.quoted_items(F.col("x")), x="['a', 'b c', 'a', '']") == ["a", "b c"]
    assert one(spark, T.clean_caption(F.col("x")), x="--a[INTER_FRAME_SEP]b   c.,") == "a b c"
    assert one(spark, T.html_escape(F.col("x")), x="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


def test_sentences_and_tags(spark):
    assert one(spark, T.sentence(F.col("x")), x=" <so> it is ") == "so it is."
    assert one(spark, T.sentence(F.col("x").cast("string")), x=None) == ""
    assert one(spark, T.word_count(F.col("x")), x="  a  b\tc ") == 3
    assert one(spark, T.repaired_tags(F.col("x"), F.col("y")), x=["Tags here", "fine-art"], y=["Reaction", "reaction"]) == ["reaction", "social contrast", "long tail"]
    assert one(spark, T.repaired_field("message", F.col("m"), F.col("n"), F.col("t")), m="tags here", n="Cat", t=["a", "b"]) == "Use Cat when a collides with b, and that mismatch becomes the point of the conversation."


def test_explanations(spark):
    r = one(spark, T.repaired_explanation(F.col("r"), F.col("n")), r="It says no", n="Grumpy Cat")
    assert r == "Grumpy Cat fits because it says no, matching this specific social situation."
    assert one(spark, T.complete_explanation(F.col("r"), F.col("n")), r=r, n="Grumpy Cat")
    assert not one(spark, T.complete_explanation(F.col("r"), F.col("n")), r="Generally, Grumpy Cat says no to all that people ask of it.", n="Grumpy Cat")


@pytest.mark.parametrize(("x", "want"), [("I told my boss that the cat ate it", True), ("The cat ate it", False), ("I saw them laughing", True), ('He said "I am late"', False), ("We waited and she left", True)])
def test_perspectives(spark, x, want):
    assert one(spark, T.several_perspectives(F.col("x")), x=x) is want


@pytest.mark.parametrize(("x", "serious", "factual"), [("my dog died today", True, False), ("please help me", True, False), ("which tax form do I need", False, True), ("what a lovely day", False, False), ("how do I file my tax return", True, True)])
def test_gates(spark, x, serious, factual):
    assert one(spark, T.serious(F.col("x")), x=x) is serious
    assert one(spark, T.factual(F.col("x")), x=x) is factual


def test_numbers(spark):
    assert one(spark, N.hamming(F.col("a"), F.col("b")), a="0f", b="0e") == 1
    assert one(spark, N.hamming(F.col("a"), F.col("b")), a="ffffffffffffffff", b="0000000000000000") == 64
    assert one(spark, N.hamming(F.col("a"), F.col("b")), a="ff", b="0") is None
    assert one(spark, N.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, N.jaccard(F.array().cast("array<string>"), F.col("b")), b=["y"]) == 0
    assert one(spark, N.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) is None
    assert one(spark, N.uniqueness(F.lit(0.82))) == pytest.approx(100)
    assert one(spark, N.uniqueness(F.lit(0.999))) == 0
    assert one(spark, N.static_prior(F.lit(90), F.lit(78))) == 86
    assert one(spark, N.expected_level(F.col("p")), p=[0.0, 0.0, 0.0, 0.0, 1.0]) == 1
    assert one(spark, N.likeliest_level(F.col("p")), p=[0.2, 0.4, 0.4, 0.0, 0.0]) == 1
    assert one(spark, N.fallback_score(F.lit(20))) == 0.25
    assert one(spark, N.finite_or(F.lit(float("nan")), 7)) == 7
    assert one(spark, N.group_probability(F.col("a"), F.col("b")), a=[0.3], b=[0.3, 0.3]) == pytest.approx(1 / 3)


def test_image_hashes(spark):
    up = np.tile(np.arange(32, dtype=np.uint8) * 8, (32, 1))
    rows = spark.createDataFrame([(bytearray(up.tobytes()),), (bytearray(b"x"),), (None,)], "p binary").select(images.perceptual_hashes("p").alias("h")).select("h.*").collect()
    assert rows[0]["dhash"] == "f" * 16 and len(rows[0]["phash"]) == 16
    assert rows[1]["dhash"] is None and rows[2]["phash"] is None
