"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

Candidates are unbroken runs of at least 16 token characters that hold a digit or change case, of any length, and runs of 6 or
more of any kind whose last words before them point to a secret and end in = or : (`name=value` gives its value). Features of a candidate: length, shares of character classes, transitions between classes, entropy, how much of it dictionary words
cover, whether it looks like a path, a UUID or plain hexadecimal, and what the words before and after it say. The forest is
trained here on labelled findings: rows (before, candidate, after, label). `labelled_findings()` makes a set from rules with a
fixed seed (keys and tokens in their usual contexts against hashes of commits, identifiers, card and phone numbers, paths,
placeholders and long words); a caller may pass findings of its own instead.

Null texts count as empty and give no findings. Texts are judged row by row and whole; ties and repeated rows change nothing, and
an empty table gives an empty one. Other columns, whatever their names, are left behind. Without labelled findings of both kinds
every candidate is reported with score 0.5.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import blocks, pick

CANDIDATE = re.compile(r"[A-Za-z0-9_\-+/=.~]{16,}")
#: Characters on either side of a candidate in which words count as its neighbours.
NEAR = 48
_WORD = re.compile(r"[a-z0-9]+")

# Words that point to a secret, words that point away from one, and common words of names and placeholders.
SECRET_WORDS = "key token secret password passwd pwd apikey auth bearer credential credentials private access client signature aws".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 hash checksum digest revision uuid guid id version isbn order invoice phone tel card path file url link href src class".split()
COMMON_WORDS = "example test sample dummy placeholder changeme your insert none null true false user name admin config default public index main data value some here token secret password key home local share version library document content string number object function module package".split()


def _class(ch: str) -> int:
    return 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3


def _mixed(run: str) -> bool:
    """Whether it holds a digit or changes case."""
    return any(map(str.isdigit, run)) or (run != run.lower() and run[1:] != run[1:].lower() and run != run.upper())


_VALUE = re.compile(r"[A-Za-z0-9_\-+/=.~]{6,}")
_ASSIGNS = re.compile(r"[=:]+[ \t]*[\"'`]?")
_NAME = re.compile(r"(?:%s)[\"'`]?[ \t]*$" % "|".join(SECRET_WORDS), re.I)


def candidates(text: str) -> list[tuple[int, int]]:
    """Begin and end of each candidate: mixed runs of 16 characters or more, and shorter or plain ones that a secret's word assigns."""
    runs = []
    for m in CANDIDATE.finditer(text):
        s = m.group().rstrip(".")
        if len(s) >= 16 and _mixed(s):
            runs.append((m.start(), m.start() + len(s)))
    starts, assigned, end = [a for a, _ in runs], [], 0
    for m in _ASSIGNS.finditer(text):
        a = m.end()
        k = bisect_right(starts, a)
        if a < end or k and a < runs[k - 1][1] or not _NAME.search(text[max(0, m.start() - NEAR) : m.start()]):
            continue  # within a candidate, or not of a secret
        if value := _VALUE.match(text, a):
            s = value.group().rstrip(".")
            if len(s) >= 6 and not (k < len(runs) and runs[k][0] < a + len(s)):
                end = a + len(s)
                assigned.append((a, end))
    return sorted(runs + assigned)


def candidate_features(before: str, candidate: str, after: str) -> list[float]:
    n = len(candidate)
    classes = [_class(c) for c in candidate]
    shares = [classes.count(k) / n for k in range(4)]
    moves = Counter(zip(classes, classes[1:], strict=False))
    steps = max(n - 1, 1)
    counts = Counter(candidate)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    lower = candidate.lower()
    covered = sum(len(w) * lower.count(w) for w in COMMON_WORDS if len(w) > 3) / n
    left, right = _WORD.findall(before.lower()), _WORD.findall(after.lower())
    near, tail = set(left[-4:]) | set(right[:2]), before.rstrip(" \"'`")
    letters = [c for c in lower if "a" <= c <= "z"]
    vowels = sum(c in "aeiou" for c in letters) / max(len(letters), 1)
    return [
        min(n, 200), *shares,
        sum(v for (a, b), v in moves.items() if a != b) / steps,
        (moves[0, 2] + moves[2, 0] + moves[1, 2] + moves[2, 1]) / steps,
        (moves[0, 1] + moves[1, 0]) / steps,
        entropy, len(counts) / min(n, 64), max(counts.values()) / n,
        min(covered, 1.0), vowels,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))), float(candidate.isdigit()),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
        float(candidate.count("/") > 1 or bool(re.search(r"\.(\w{2,4})$", candidate))), candidate.count(".") / n, candidate.count("-") / n,
        float(tail.endswith(("=", ":"))), float(any(w in near or any(x.endswith(w) for x in left[-2:]) for w in SECRET_WORDS)), float(any(w in near for w in HARMLESS_WORDS)),
        float(before[-1:] in "\"'`" and before[-1:] != "" and after[:1] == before[-1:]),
    ]


def labelled_findings(n: int = 3_000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """before, candidate, after, label: half of them secrets."""
    r = random.Random(seed)
    low, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "an ter tion er re in the st ou en de la que ver ge sch ing ed ly ment con dor".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    prose = lambda k: " ".join(word() for _ in range(r.randint(1, k)))
    out = []
    for i in range(n):
        if i % 2:
            value = r.choice([lambda: some(low, 32, 64), lambda: some(low, 40, 40), lambda: some(alnum, 20, 60), lambda: some(alnum + "+/", 40, 60), lambda: "AKIA" + some(alnum[:26] + "0123456789", 16, 16), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(alnum, 24, 40)])()
            name = r.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "apiKey", "Authorization: Bearer", "private key"])
            open_, close = r.choice([(' = "', '"'), ("=", ""), (": ", ""), (": '", "'"), (' "', '"'), (' := "', '"')])
            out.append((f"{prose(4)} {name}{open_}", value, f"{close} {prose(3)}", 1))
        else:
            kind = r.randrange(9)
            value, name = [
                lambda: (some(low, 40, 40), r.choice(["commit ", "revision ", "sha1: ", "sha "])),
                lambda: (some(low, 32, 64), r.choice(["md5 ", "checksum: ", "sha256=", "digest ", "hash "])),
                lambda: (f"{some(low, 8, 8)}-{some(low, 4, 4)}-{some(low, 4, 4)}-{some(low, 4, 4)}-{some(low, 12, 12)}", r.choice(["uuid ", "id: ", "", "guid="])),
                lambda: (some("0123456789", 16, 20), r.choice(["", "card ", "order ", "phone ", prose(2) + " "])),
                lambda: ("/".join(word() for _ in range(4)) + r.choice([".py", ".html", "/index1.js", "/v2"]), r.choice(["path ", "file ", "", "src="])),
                lambda: (r.choice(["your_api_key_here_1", "example_token_12345", "changeme_changeme1", "xxxxxxxxxxxxxxxxxxxx1", "INSERT_TOKEN_HERE_0", "dummy-secret-value-1", "0000000000000000000000"]), r.choice(["token = ", "api_key=", "password: ", "secret: "])),
                lambda: ("".join(word().capitalize() for _ in range(5)), r.choice(["class ", "", "function "])),
                lambda: ("-".join([word() for _ in range(4)] + [str(r.randint(1, 999))]), r.choice(["", "link ", "href="])),
                lambda: (f"{word()}.{word()}{r.randint(1, 99)}.example.com", r.choice(["host ", "", "url "])),
            ][kind]()
            quote = r.choice(["", '"'])
            out.append((f"{prose(4)} {name}{quote}", value, f"{quote} {prose(3)}", 0))
    return out


class Forest:
    """Random forest of Gini trees, kept as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 9, seed: int = 11):
        self.trees: list[tuple[np.ndarray, ...]] = []
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            feature, cut, left, right, share = [], [], [], [], []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(feature)
                feature.append(-1), cut.append(0.0), left.append(0), right.append(0), share.append(float(y[rows].mean()))
                if level == depth or len(rows) < 8 or share[at] in (0.0, 1.0):
                    return at
                best = (1e9, -1, 0.0)
                for f in rng.permutation(x.shape[1])[: max(2, int(math.sqrt(x.shape[1])) + 1)]:
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows, f][order], np.cumsum(y[rows][order])
                    ends = np.flatnonzero(v[1:] > v[:-1])
                    if not len(ends):
                        continue
                    n, k = np.arange(1, len(rows))[ends], ones[ends]
                    m, j = len(rows) - n, ones[-1] - k
                    gini = k * (n - k) / n + j * (m - j) / m
                    i = int(np.argmin(gini))
                    if gini[i] < best[0]:
                        best = (float(gini[i]), int(f), float((v[ends[i]] + v[ends[i] + 1]) / 2))
                if best[1] < 0:
                    return at
                feature[at], cut[at] = best[1], best[2]
                low = x[rows, best[1]] <= best[2]
                left[at] = grow(rows[low], level + 1)
                right[at] = grow(rows[~low], level + 1)
                return at

            grow(rows, 0)
            self.trees.append(tuple(map(np.array, (feature, cut, left, right, share))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    x = np.array([candidate_features(b, c, a) for b, c, a, _ in findings], dtype=np.float64)
    return Forest(x, np.array([f[3] for f in findings], dtype=np.int64))


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, findings (start, stop in code points, score of those at the threshold or above), redacted text."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for block in blocks(batches):
            texts = [t or "" for t in block.column(1).to_pylist()]
            spots = [candidates(t) for t in texts]
            x = np.array([candidate_features(t[max(0, a - NEAR) : a], t[a:b], t[b : b + NEAR]) for t, p in zip(texts, spots, strict=True) for a, b in p], dtype=np.float64)
            scores = iter(forest.predict(x).tolist())
            found = [[(a, b, s) for (a, b), s in zip(p, scores, strict=False) if s >= threshold] if p else [] for p in spots]
            redacted = []
            for text, hits in zip(texts, found, strict=True):
                at, out = 0, []
                for a, b, _ in hits:
                    out += [text[at:a], "[SECRET]"]
                    at = b
                redacted.append("".join(out) + text[at:])
            listed = [[{"start": a, "stop": b, "score": s} for a, b, s in hits] for hits in found]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(map(len, spots), pa.int64()), pa.array(listed, kind), pa.array(redacted, pa.string())], names=["doc_id", "n_candidates", "findings", "redacted"])

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_candidates long, findings array<struct<start:int,stop:int,score:double>>, redacted string")
