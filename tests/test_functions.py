"""Hand-made rows per expression."""

import math
import re

import pytest
from pyspark.sql import functions as F

from credsieve.functions import clean, context, extract, mask, score, urls


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "line, secret, code",
    [
        ('api_key = "abcdefgh1"', "abcdefgh1", 'api_key ="abc##########"'),
        ("token abcdefgh1", "abcdefgh1", "token ##########"),
        ("token: abcdefgh1\r", "abcdefgh1", "token:abcd##########"),
        ("abcdefgh1 token:", "abcdefgh1", "########## token:"),
        ("abcdefgh1 token:   ", "abcdefgh1", "########## token:   "),
        ("token abcdefgh1 : note", "abcdefgh1", "token ########## :note##########"),
        ("a=b:c abcdefgh1", "abcdefgh1", "a=b:c ##########"),
        ("k=abcdefgh1abcdefgh1", "abcdefgh1", "k=abcd##########"),
    ],
)
def test_mask(spark, line, secret, code):
    assert one(spark, mask.mask_line(F.lit(line), F.lit(secret))) == code


def test_mask_compat_leaves_secret_before_separator(spark):
    line = "token abcdefgh1 : note"
    code = one(spark, mask.mask_line(F.lit(line), F.lit("abcdefgh1"), compat_mask=True))
    assert code == "token abcdefgh1 :note##########"


def test_entropy_in_nats(spark):
    assert one(spark, score.shannon_entropy(F.lit("aab1c2d3"))) == pytest.approx(1.906155, abs=1e-6)
    assert one(spark, score.shannon_entropy(F.lit("aaaa"))) == pytest.approx(0)


def test_counts_and_scores(spark):
    assert one(spark, score.keyword_count(F.lit("Token token TOKENS"), F.lit("token"))) == 3
    assert one(spark, score.keyword_count(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, score.count_score(F.lit(3))) == pytest.approx(math.log2(50) / 3)
    assert one(spark, score.dictionary_score(F.lit(0.0))) == pytest.approx(math.log2(100))


def test_ngrams(spark):
    assert one(spark, score.char_ngrams(F.lit("ABCD"))) == ["abc", "bcd", "abcd"]
    assert one(spark, score.char_ngrams(F.lit("ab"))) == []
    assert one(spark, score.char_ngrams(F.lit("a \t b"))) == ["a b"]


def hit(spark, line, kw, secret, test=context.line_is_cred_hit, **flags):
    return one(spark, test(F.lit(line), F.lit(kw), F.lit(secret), **flags))


def test_cred_lines(spark):
    assert hit(spark, "token = abc12345", "token", "abc12345")
    assert hit(spark, "TOKEN = abc12345", "token", "abc12345")
    assert not hit(spark, "TOKEN = abc12345", "token", "abc12345", case_sensitive=True)
    assert not hit(spark, "token abc12345", "token", "abc12345")
    assert not hit(spark, "a = token abc12345", "token", "abc12345")
    # other case: the keyword position counts as none, so any separator is behind it
    assert hit(spark, "a = TOKEN abc12345", "token", "abc12345")
    assert not hit(spark, "abc12345 = token", "token", "abc12345")
    # only the first separator of each sort counts
    assert hit(spark, "a:b token = abc12345", "token", "abc12345")
    assert not hit(spark, "a=b token = abc12345", "token", "abc12345")


def test_key_lines(spark):
    key = context.line_is_key_hit
    assert hit(spark, "my token abc12345", "token", "abc12345", key)
    assert not hit(spark, "see www token abc12345", "token", "abc12345", key)
    assert hit(spark, "see WWW token abc12345", "token", "abc12345", key)
    assert not hit(spark, "abc12345 token", "token", "abc12345", key)
    assert not hit(spark, "token1234", "token", "token1234", key)


def test_first_hit_skips_long_lines(spark):
    content = "token = abc12345" + " " * 300 + "\ntoken: abc12345\ntoken = abc12345"
    first = context.first_hit(F.lit(content), F.lit("token"), F.lit("abc12345"), True)
    assert one(spark, first) == "token: abc12345"
    exactly = "token = abc12345" + " " * 284
    assert len(exactly) == 300
    assert one(spark, context.first_hit(F.lit(exactly), F.lit("token"), F.lit("abc12345"), True)) is None
    assert one(spark, context.first_hit(F.lit(exactly[:-1]), F.lit("token"), F.lit("abc12345"), True))


def test_credential_tokens(spark):
    words = "u0abc123 0xabc1234 rfc12345 ahttp123 abcdefgh 12345678 abc1234 static1 abc12 abc1234"
    assert one(spark, extract.cred_candidates(F.lit(words))) == ["abc1234"]
    assert one(spark, extract.cred_tokens(F.lit(words))) == ["abc1234"]


def test_credential_cleaning(spark):
    text = "k='ab-c1234$x' mail me.x+y@host.co.uk at http://u.v/w?x=1#frag or www.site.com/p1/q2 _k_"
    cleaned = one(spark, clean.clean_for_creds(F.lit(text)))
    assert cleaned.split() == ["k", "ab", "c1234$x", "mail", "at", "frag", "or", "_k_"]


def test_bare_urls(spark):
    def stripped(text):
        return one(spark, clean.strip_bare_urls(F.lit(text)))

    assert stripped("a self.id main.py x.com y") == "a self.id main.py   y"
    assert stripped("see Example.COM:80/path, z") == "see   z"
    assert stripped("x.commit y.com_z") == "x.commit y.com_z"
    assert stripped("a.com b.org\nc.net") == "   \n "


def test_emails_back_to_back(spark):
    text = "a@b.c_d@e.f g@h.i, j..k+l@m-n.o- @p.q r@s t@u.v"
    assert one(spark, clean.strip_emails(F.lit(text))) == re.sub(clean.EMAIL, " ", text)


def test_key_cleaning(spark):
    assert one(spark, clean.clean_for_keys(F.lit("a'b(c)0xd_e+f-g:h"))) == "a b c  d e+f-g:h"


def test_key_patterns(spark):
    def keys(text):
        return sorted(one(spark, extract.key_candidates(F.lit(text))))

    akia = "AKIA" + "A1B2" * 4
    assert keys(f"x {akia} y") == [akia]
    sha = "0123456789" * 4
    assert keys(sha) == sorted([sha, sha[:24]])
    assert keys("-----BEGIN RSA PRIVATE KEY-----") == ["BEGIN RSA PRIVATE KEY"]
    slack = "xoxb-" + "-".join(["123456789012"] * 3) + "-" + "a1" * 16
    assert slack in keys(slack)
    assert keys("nothing") == []


def test_aws_secret_line(spark):
    block = "aA0/" * 10
    line = f"x api-key: {block} tail"
    found = one(spark, extract.key_candidates(F.lit(f"first\n{line}\nlast")))
    assert f"x api-key: {block}" in found
    # no upper-case letter from the block on
    low = "a0/b" * 10
    assert not any("api-key" in k for k in one(spark, extract.key_candidates(F.lit(f"X api-key {low} x"))))
    # the name must come before the block
    assert not any("api-key" in k for k in one(spark, extract.key_candidates(F.lit(f"{block} api-key"))))
    # of several blocks the last one ends the match
    two = f"api-key {block} {block} z"
    assert f"api-key {block} {block}" in one(spark, extract.key_candidates(F.lit(two)))


@pytest.mark.parametrize("content, kept", [("a\nb", False), ("a\nb\n", True), ("", False), ("\n\n", True)])
def test_line_gate(spark, content, kept):
    assert one(spark, clean.long_enough(F.lit(content))) is kept


@pytest.mark.parametrize("n, kept", [(30, True), (31, False)])
def test_url_gate(spark, n, kept):
    text = "http://a.example.com/x1\n" * n + "me@mail.example.com"
    assert one(spark, clean.few_urls(F.lit(text), clean.strip_links(F.lit(text)))) is kept


@pytest.mark.parametrize("n, kept", [(0, False), (1, True), (20, True), (21, False)])
def test_candidate_gate(spark, n, kept):
    text = " ".join(f"abcdefg{i:02d}" for i in range(n))
    assert one(spark, extract.candidate_count_ok(extract.cred_candidates(F.lit(text)))) is kept


def test_urls(spark):
    site, raw = "https://git.example.com", "https://raw.example.com"
    html = f"{site}/own/repo/blob/main/repo/own/a.tar.py"
    fetched = f"{raw}/own/repo/main/repo/own/a.tar.py"
    assert one(spark, urls.to_raw_url(F.lit(html), site, raw)) == fetched
    assert one(spark, urls.to_blob_url(F.lit(fetched), site, raw)) == html
    assert one(spark, urls.url_extension(F.lit(html))) == "py"
    assert one(spark, urls.url_extension(F.lit(f"{site}/o/r/blob/main/Makefile"))) == "com/o/r/blob/main/Makefile"
    assert one(spark, urls.raw_file_path(F.lit(fetched))) == "repo/own/a.tar.py"
    assert one(spark, urls.blob_file_path(F.lit(html))) == "repo/own/a.tar.py"
    contents = urls.to_contents_url("https://x/", F.lit("own/repo"), F.lit("p/a.py"))
    assert one(spark, contents) == "https://x/own/repo/contents/p/a.py"
    assert one(spark, urls.contents_file_path(F.lit("https://x/own/repo/contents/p/a.py"))) == "p/a.py"
    assert one(spark, urls.url_repo(F.lit("https://x"))) is None


LONG = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "a" * LONG,
        "a1" * (LONG // 2),
        "a." * (LONG // 2),
        "a.com" * (LONG // 5),
        "a-b_c+" * (LONG // 6),
        "http://" + "a" * LONG,
        "http://a" * (LONG // 8),
        "a@" * (LONG // 2),
        "a@b." * (LONG // 4),
        "0" * LONG + " googleusercontentn",
        "api-key " + "0a" * (LONG // 2),
        "api-key " * (LONG // 8),
        "api-key A " + ("0" * 40 + " ") * (LONG // 41),
        " " * LONG,
    ],
)
def test_megabytes_on_one_line(spark, text):
    """No pattern recurses or turns quadratic on a long line."""
    df = spark.createDataFrame([(text,)], ["content"]).repartition(1)
    content = F.col("content")
    df.select(
        F.length(clean.clean_for_creds(content)),
        F.size(extract.cred_candidates(clean.clean_for_creds(content))),
        F.size(extract.key_candidates(clean.clean_for_keys(content))),
        clean.url_count(content, clean.strip_links(content)),
    ).collect()


def test_occurrences_of_long_characters(spark):
    row = spark.createDataFrame([("üxüüx🔑ü🔑", "", None)], "t string, e string, n string")
    for word, n in (("ü", 4), ("üx", 2), ("🔑", 2), ("üü", 1), ("y", 0)):
        counts = row.select(*[score.occurrences(F.col(c), F.lit(word)) for c in ("t", "e", "n")]).first()
        assert tuple(counts) == (n, 0, None)


@pytest.mark.parametrize("most", [0, 256])
def test_tokens_are_those_of_the_full_list(spark, monkeypatch, most):
    """Also when many stop words are given, and with spaces of all kinds inside."""
    monkeypatch.setattr(extract, "MOST_SINGLE_WORDS", most)
    texts = [
        "abcdefg1 static1 U0bcdef1 0Xabcdef RFCabc12 ahTTpb12 1234567 abcdefg abc1", "a\u2003bcdefgh1\u2003x abcdef\u20282",
        "\u2003abcdefg1\u3000hijklmn2 abcdefg1", "", None, "Åbcdef12 \U0001f511abcde1", "abcdefg1\u2003abcdefg", "Kubernetes1\u212a",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (extract.R.STOP_WORDS, (), ("abcdefg1",)):
        found = extract.cred_candidates(F.col("t"), words), extract.cred_tokens(F.col("t"), words)
        rows = df.select(*found).collect()
        assert [r[0] for r in rows] == [r[1] for r in rows]
    assert [r[0] for r in rows[:3]] == [["static1"], ["bcdefgh1"], ["hijklmn2"]]
    assert rows[5][0] == ["Åbcdef12", "\U0001f511abcde1"]
