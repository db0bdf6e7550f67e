"""A scan of one file, row by row, to compare the engine with."""

import math
import re
from collections import Counter

from credsieve import resources as R

URL = r"https?://[!$-_a-z]+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
BARE = (
    r"[A-Za-z0-9.-]*[A-Za-z0-9]\.(?i:" + "|".join(R.TLDS) + r")(?![A-Za-z0-9_])"
    r"(?:[/:?#][!$-_a-z]*)?"
)
# Fixed value: an AWS secret on a line that names it.
AWS_SECRET = (
    r"(?:.*awsSecretKey|.*aws_secret|.*api-key|.*aws_account_secret).*"
    r"(?=.*[A-Z])(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"
)


def candidates(content, kind):
    text = re.sub(EMAIL, " ", re.sub(URL, " ", content))
    urls = len(re.findall(URL, content)) + len(re.findall(BARE, text))
    if urls > 30 or len(content.split("\n")) <= 2:
        return set()
    if kind == "keys":
        for c in R.KEY_NOISE:
            text = text.replace(c, " ")
        text = text.replace("0x", " ")
        found = {m.group(0) for _, p in R.KEY_PATTERNS for m in re.finditer(p, text)}
        found |= set(re.findall(AWS_SECRET, text))
    else:
        text = re.sub(BARE, " ", text)
        for c in R.CRED_NOISE:
            text = text.replace(c, " ")
        found = {w for w in text.split() if is_cred(w)}
    found.discard("")
    return found if len(found) <= 20 else set()


def is_cred(word):
    low = word.lower()
    if len(word) < 7 or word in R.STOP_WORDS or "http" in low:
        return False
    if low.startswith(("u0", "0x", "rfc")):
        return False
    return bool(re.search("[0-9]", word) and re.search("[a-zA-Z]", word))


def entropy(text):
    return -sum(n / len(text) * math.log(n / len(text)) for n in Counter(text).values())


def is_hit(line, kw, secret, kind):
    if len(line) >= 300 or any(w in line for w in ("http", "www", "uuid")):
        return False
    at = line.find(secret)
    if at < 0 or line == secret or not 0 <= line.lower().find(kw.lower()) < at:
        return False
    if kind == "keys":
        return True
    return any(line.find(kw) < line.find(mark) < at for mark in ":=")


def scan(content, extension, keywords, kind):
    """{(keyword, secret): (line, count, entropy)} of one file."""
    if extension == "md":
        return {}
    found = {}
    secrets = candidates(content, kind)
    for kw in dict.fromkeys(keywords):
        count = content.lower().count(kw.lower())
        if not count:
            continue
        for secret in secrets:
            if entropy(secret) <= 1.5:
                continue
            line = next((l for l in content.split("\n") if is_hit(l, kw, secret, kind)), None)
            if line is not None:
                found[kw, secret] = (line, count, round(entropy(secret), 6))
    return found
