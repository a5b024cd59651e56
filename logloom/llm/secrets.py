"""Secret scan: credential patterns, and guess-cost estimates of values in credential contexts.

Patterns find assignments of credentials, access key ids and long hex runs. Every value that follows a credential word
(a password, a token, a login, a bearer header), or a name of any length that holds one, and that these do not hold whole is judged
by the number of guesses it would take: dynamic programming finds the cheapest split of the value into common words, dates,
repeats, keyboard walks and brute-force characters. A value that takes at least 10**`min_log10` guesses is a secret of kind
guess. Words are those of public vocabularies, by frequency, so that ordinary words of many languages cost little. Where no
sign but a space or "is" stands before it, a word of letters of one case counts only if next to nothing of it is made of words.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import free_names

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, also at the end of a longer name; then the rest of the name, and the value that follows.
CREDENTIAL = re.compile(
    r"(?:password|passwd|secret|token|api[_-]?key|(?<![A-Za-z0-9])(?:pwd|passphrase|passcode|pass\x20phrase|credentials?|bearer|authorization|(?:private|access|signing)[_\x20-]?key|client_?id|login))(?![A-Za-z0-9])",
    re.A | re.I,
)
NAME_REST = re.compile(r"(?:[_-]+[A-Za-z0-9]+)*+", re.A)
VALUE = re.compile(r"""["']?(?P<sep>[\x20\t]*(?:=>|->|:=|[:=])[\x20\t]*|[\x20\t]+is[\x20\t]+|[\x20\t]+)(?:"(?P<double>[^"\r\n]{8,})|'(?P<single>[^'\r\n]{8,})|(?!["'])(?P<bare>[!-~]{8,}))""", re.A | re.I)
#: One of these is in every text in which ASSIGN or CREDENTIAL matches.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("pwd", "pass", "secret", "token", "credential", "bearer", "authorization", "key", "client", "login")
#: After a space or "is", a word like this must cost so much a letter; random letters cost 1, words of the vocabularies' languages less.
PROSE_WORD = re.compile("[A-Za-z]?[a-z]+|[A-Z]+")
PROSE_COST = 0.92
#: Public vocabularies of subwords, most frequent first; a token of at least so many letters is a word. Their size bounds what is broadcast.
WORD_FILES = ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LEAST_LETTERS = 4
MIN_LOG10 = 9.0

# Common words of passwords, most frequent first.
COMMON = (
    "password qwerty dragon monkey letmein football baseball welcome shadow master login princess sunshine iloveyou admin "
    "superman batman trustno hello freedom whatever secret summer winter spring autumn monday friday sunday january june july "
    "october november december love money secure access flower cookie ginger pepper orange banana apple cherry purple silver "
    "golden yellow green black white red blue star king queen angel devil tiger lion eagle falcon wolf bear horse house home "
    "computer internet network server system linux windows google test user guest root default change please example demo "
    "sample hunter soccer hockey tennis music guitar london paris berlin madrid america market company office team project "
    "pass word key code open door light dark night day life time world happy lucky magic power super mega ultra first last"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_RANK = {w: i + 1 for i, w in reversed([*enumerate(COMMON)])}
_LEET = str.maketrans("430157$@!", "aeoistsai")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
_DATE_LENGTHS = (4, 6, 7, 8, 9, 10)
_AT = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
#: Each part doubles the guesses.
_PART = math.log10(2)


def vocabulary(path: str) -> list[str]:
    """The tokens of a vocabulary file (of JSON, or of lines with a token in base64 and its rank), most frequent first."""
    if path.endswith(".json"):
        ranked = json.loads(Path(path).read_text())["model"]["vocab"]
        return [w.removesuffix("</w>") for w in sorted(ranked, key=ranked.get)]
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return [base64.b64decode(token).decode("utf-8", "ignore").strip().lower() for token, _ in lines]


@functools.cache
def word_ranks(files: tuple[str, ...] = WORD_FILES) -> dict[str, int]:
    """Words with their ranks: those of COMMON, then the files' in turn."""
    ranks = dict(_RANK)
    for turn in itertools.zip_longest(*map(vocabulary, files)):
        for word in turn:
            if word and len(word) >= LEAST_LETTERS and word.isalpha() and word not in ranks:
                ranks[word] = len(ranks) + 1
    return ranks


def _next_to(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def repeat_cost(length: int) -> float:
    return math.log10(95 * length) + _PART


def walk_cost(length: int) -> float:
    return math.log10(len(_AT) * length) + 0.3 * (length - 1) + _PART


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """What a common word costs, in either case and with signs in place of letters; None if part is none."""
    low = part.lower()
    if rank := ranks.get(low):
        cost = math.log10(rank)
    elif rank := ranks.get(low.translate(_LEET)):
        cost = math.log10(rank * 4)
    else:
        return None
    return cost + (math.log10(2) if low != part else 0.0) + _PART


def date_cost(part: str) -> float | None:
    """What a date or a year costs; None if part is none."""
    if len(part) not in _DATE_LENGTHS or not part[0].isdigit() or not _DATE.fullmatch(part):
        return None
    return math.log10(365 * 120 if len(part) > 4 else 120) + _PART


def log10_guesses(value: str, ranks: dict[str, int] = _RANK) -> float:
    """The least log10 of guesses over all splits of value into common words (ranks: word to rank), dates, repeats and
    keyboard walks of three characters or more, and single characters of any kind.

    Repeats and walks are tried from where one begins, from the place after it (a walk may end with a repeat's first
    character, or the other way about), and from where a word or a date ends within it: from anywhere else it is never
    cheaper, as a single character costs more than a longer repeat or walk, and two of them more than one.
    """
    n, low = len(value), [c.lower() for c in value]
    longest = max(map(len, ranks), default=0)
    best = [0.0] + [math.inf] * n
    word_ends = [False] * (n + 1)
    ahead: dict[int, float] = {}  # the cheapest word or date that ends at a place still ahead
    runs, walks = [0], [0]
    for i in range(n + 1):
        if i:
            best[i] = best[i - 1] + 1.0
            if i > 1 and value[i - 1] != value[i - 2]:
                runs = [i - 1]
            if i > 1 and not _next_to(low[i - 1], low[i - 2]):
                walks = [i - 1]
            best[i] = min([best[i], *(best[j] + repeat_cost(i - j) for j in runs if i - j >= 3), *(best[j] + walk_cost(i - j) for j in walks if i - j >= 3)])
            if i in ahead:
                cost = ahead.pop(i)
                if cost < best[i]:
                    best[i] = cost
                    word_ends[i] = True
            if i > runs[0] and (word_ends[i] or i == runs[0] + 1):
                runs.append(i)
            if i > walks[0] and (word_ends[i] or i == walks[0] + 1):
                walks.append(i)
        for length in range(3, min(longest, n - i) + 1):
            if (cost := word_cost(value[i : i + length], ranks)) is not None:
                ahead[i + length] = min(ahead.get(i + length, math.inf), best[i] + cost)
        if i < n and value[i].isdigit():
            for length in _DATE_LENGTHS:
                if i + length <= n and (cost := date_cost(value[i : i + length])) is not None:
                    ahead[i + length] = min(ahead.get(i + length, math.inf), best[i] + cost)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and value of the pattern kinds, in code points, by start and then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, taken: list[tuple[int, int, str, str]], min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str, str]]:
    """Values in credential contexts that take many guesses, whole, unless the spans already taken hold all of them."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found, reach, named, ranks = [], 0, 0, ranks or word_ranks()
    for word in CREDENTIAL.finditer(text):
        if word.start() < named:
            continue  # of the same name
        named = NAME_REST.match(text, word.end()).end()
        m = VALUE.match(text, named)
        if not m:
            continue
        group, prose = m.lastgroup, m["sep"].strip().lower() in ("", "is")
        value = m[group].split(" ")[0] if prose else m[group]
        if group == "bare":
            value = value.rstrip("\"'.,;:)]}>")
        start, end = m.start(group), m.start(group) + len(value)
        if end <= reach or _covered(start, end, taken):
            continue
        plain = value.rstrip("\"'.,;:!?)]}>")
        least = max(min_log10, PROSE_COST * len(plain)) if prose and PROSE_WORD.fullmatch(plain) else min_log10
        if log10_guesses(plain if least > min_log10 else value, ranks) >= least:
            found.append((start, end, "guess", value))
            reach = end
    return found


def _covered(start: int, end: int, spans: list[tuple[int, int, str, str]]) -> bool:
    """Whether spans, which are in order, hold all of start to end."""
    for s, e, *_ in spans:
        if s <= start < e:
            start = e
    return start >= end


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def scan_text(text: str | None, min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> dict:
    text, ranks = text or "", ranks or word_ranks()
    base = base_spans(text)
    every = sorted([*base, *guess_spans(text, base, min_log10, ranks)], key=lambda s: (s[0], KINDS.index(s[2])))
    return {
        "n_assign": sum(s[2] == "assign" for s in base),
        "n_access": sum(s[2] == "access" for s in base),
        "n_hex": sum(s[2] == "hex" for s in base),
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
        "spans": joined(every),
        "max_log10_guesses": max((log10_guesses(s[3], ranks) for s in every if s[2] in ("assign", "guess")), default=None),
    }


def redact_text(text: str | None, mark: str = "[secret]", min_log10: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> str | None:
    """text with every span replaced by mark; overlapping spans give one mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, end, *_ in sorted([*base, *guess_spans(text, base, min_log10, ranks)]):
        if end > at:
            out += [text[at:start], mark] if start >= at else []
            at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, files=WORD_FILES) -> DataFrame:
    """docs' doc_id with the counts and spans of its secrets, a row for each row of docs.

    Spans are code points, end exclusive. Null and empty texts have no spans. No text is cut; a value's cost takes
    time in proportion to its length. A row that repeats is scanned again; an empty table gives no rows; other columns are left
    out, whatever their names. files are vocabularies, read by the driver.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(files))
    kind = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_log10_guesses double"

    @F.pandas_udf(kind)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in kind.split(", ")]
        for texts in batches:
            yield pd.DataFrame([scan_text(t, min_log10, ranks.value) for t in texts], columns=columns).astype({"max_log10_guesses": "float64"})

    return docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", min_log10: float = MIN_LOG10, files=WORD_FILES) -> DataFrame:
    """docs with each secret in text replaced by mark; n_chars, if there, follows where a text changed.

    Null and empty texts stay as they are. Other columns, whatever their names, are kept, and so are rows that repeat; an
    empty table stays empty.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(files))

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redact_text(t, mark, min_log10, ranks.value), na_action="ignore")

    (new,) = free_names(docs.columns, "redacted")
    changed = docs.withColumn(new, redact("text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(new).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new).cast("long")))
    return changed.withColumn("text", F.col(new)).select(*docs.columns)
