import hashlib
import random
import re

from pyspark.sql import functions as F

from textward.functions import language as L
from textward.functions import text as T

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r["v"] for r in df.select("i", expr(F.col("text")).alias("v")).orderBy("i").collect()]


def random_texts(n=400, seed=3):
    rng = random.Random(seed)
    alphabet = list("abcXYZ éñÀɏ×÷Ж漢1.-\n\t\r") + SPACES + ["ignore ", "act  as", "System", " dan ", "😊", "İ"]
    return ["", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def tagged_by_re(text):
    flags = re.I
    out = re.sub(r"[^\x00-\x7F]+", " ", text.strip())
    found = []
    for tag, words in T.ATTACK_TAGS.items():
        out, n = re.subn(rf"\b({'|'.join(words)})\b", f" {tag} ", out, flags=flags)
        if n:
            found.append(tag)
    return re.sub(r"\s+", " ", out).strip().lower(), found


def test_whitespace_is_pythons(spark):
    texts = random_texts() + [s + "a" + s + "b" + s for s in SPACES]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.normalize_whitespace) == [" ".join(t.split()) for t in texts]
    assert column(spark, texts, T.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, T.is_blank) == [not t.strip() for t in texts]
    assert column(spark, texts, T.single_line) == [t.replace("\n", " ").strip() for t in texts]
    assert column(spark, texts, lambda c: T.has_more_words_than(c, 5)) == [len(t.split()) > 5 for t in texts]
    assert column(spark, texts, lambda c: T.clip(c, 5)) == [t.strip()[:5] for t in texts]


def test_letters_and_words(spark):
    texts = random_texts(seed=4)
    only = [re.sub(r"[^a-zA-ZÀ-ɏ]", "", t) for t in texts]
    assert column(spark, texts, T.latin_letter_count) == [len(t) for t in only]
    assert column(spark, texts, T.has_two_latin_letters) == [len(t) >= 2 for t in only]
    words = [set(re.findall(r"[a-zA-ZÀ-ɏ]+", t.lower())) for t in texts]
    assert [set(w) for w in column(spark, texts, T.latin_words)] == words


def test_near_key(spark):
    texts = random_texts(seed=5) + ["A" * 299 + " x tail", "a" * 299 + "  y", " " + "b" * 400]
    keys = column(spark, texts, T.near_duplicate_key)
    assert keys == [hashlib.sha256(t.lower().strip().encode()).hexdigest() for t in texts]
    short = column(spark, texts, lambda c: T.near_duplicate_key(c, 300))
    assert short == [hashlib.sha256(t[:300].lower().strip().encode()).hexdigest() for t in texts]


def test_texts_that_differ_late_have_different_keys(spark):
    texts = ["a" * 301 + "x", "a" * 301 + "y", " " + "A" * 301 + "X\n"]
    first, second, third = column(spark, texts, T.near_duplicate_key)
    assert first == third != second
    assert [len(t) for t in column(spark, ["b" * 20_000], T.clip)] == [20_000]


def test_attack_tags(spark):
    texts = random_texts(seed=6) + [
        "Please IGNORE the system prompt", "act\tas DAN; as\n if", "role-play and roleplay", "danger rules",
        "é ignoré ignore", "override_this", "jailbreak",
    ]
    want = [tagged_by_re(t) for t in texts]
    assert column(spark, texts, T.tag_attack_words) == [w[0] for w in want]
    assert column(spark, texts, T.attack_tag_flags) == [w[1] for w in want]


ROUTED = {
    "gracias": ("es", 0.75, "lingua"),
    "12345 😊": ("en", 0.0, "fallback_no_alpha"),
    "Привет как дела": ("en", 0.0, "fallback_no_alpha"),
    "Hola necesito ayuda con mi cuenta": ("es", 0.75, "fasttext"),
    "x y": ("en", 0.75, "lingua"),
    "nota": ("en", 0.75, "lingua"),
    "¿tienes": ("es", 0.95, "lingua"),
    "mañana": ("es", 0.95, "lingua"),
    "This product is absolutely terrible and I want a refund.": ("en", 0.75, "fasttext"),
}


def test_routing(spark):
    """Cases written by hand, one for each way a text can go."""
    got = column(spark, list(ROUTED), lambda c: L.detect(c, preferred="en"))
    assert {text: tuple(row) for text, row in zip(ROUTED, got)} == ROUTED


def test_history_and_low_confidence(spark):
    history = lambda c: L.detect(c, preferred="en", history=F.lit("es"))
    assert column(spark, ["12345 😊"], history) == [("es", 0.0, "fallback_no_alpha")]
    empty = lambda c: L.detect(c, preferred="en", history=F.lit(""))
    assert column(spark, ["12345"], empty)[0]["lang"] == "en"

    def unsure(text):
        return F.struct(F.lit("fr").alias("lang"), F.lit(0.59).alias("confidence"))

    def sure(text):
        return F.struct(F.lit("fr").alias("lang"), F.lit(0.6).alias("confidence"))

    plugged = lambda d: lambda c: L.detect(c, preferred="es", short_detector=d, long_detector=d)
    assert column(spark, ["bonjour toi"], plugged(unsure)) == [("es", 0.59, "fallback_lingua")]
    assert column(spark, ["a b c d e f g"], plugged(unsure))[0]["method"] == "fallback_fasttext"
    assert column(spark, ["bonjour toi"], plugged(sure)) == [("en", 0.6, "lingua")]


def test_buckets(spark):
    for configured, want in ((["en", "es"], ["es", "en"]), (["de"], ["de", "de"]), ([], ["es", "fr"])):
        assert column(spark, ["es", "fr"], lambda c: L.resolve_bucket(c, configured)) == want
