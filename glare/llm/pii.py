"""Operator 9: personal data by weak supervision."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glare.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE = KINDS[:4]

# base patterns (fixed values of the contract; an address is searched from its @)
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# shapes that only the labelers judge
ASSIGNED = re.compile(r"[=:]\x20{0,2}[\"']?([^\s\"'<>,;]{6,})")
KEY_BEFORE = re.compile(r"([A-Za-z][A-Za-z_-]{1,23})[\"']?\x20{0,2}$")
BARE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])")
TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.?\x20([A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?)")

# gazetteers
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us example test".split())
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65", "22", "23", "24", "25", "26", "27")
SECRET_WORDS = ("pass", "pwd", "token", "secret", "key", "credential", "auth")
FIRST_NAMES = frozenset("anna anne ben carlos clara david emma hans ines jean john jose julia karl laura louis luis maria "
                        "mark martin mary michael paul peter pierre sofia thomas".split())
# context words per kind, looked for in the characters before a span
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("login", "password", "token", "secret", "key", "access"),
    "name": ("name", "dear", "signed", "contact", "by"),
}
AGAINST = ("version", "isbn", "order", "invoice", "page", "chapter", "section", "no.")
CONTEXT_CHARS = 32
#: a span that only the method proposes is reported from this probability on
THRESHOLD = 0.7
LABELERS = ("shape", "checksum", "gazetteer", "context", "against")
#: checksums are arithmetic, not opinion: their votes (-1, 0, 1) keep these
#: probabilities for other and for personal spans; the other labelers' are estimated
CHECKSUM = np.array([[0.7, 0.2, 0.1], [0.000001, 0.099999, 0.9]])
#: how far each labeler is trusted before its reliability has been estimated
TRUST = np.array([1.0, 3.0, 1.0, 1.5, 1.5])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, accepted) of every base match, in code points."""
    out, last = [], 0
    for m in AT_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end(), True))
            last = m.end()
    for m in IP.finditer(text):
        out.append(("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                                                  for p in m.group().split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            out.append(("card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
    for m in PHONE.finditer(text) if "+" in text else ():
        out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base, votes): base spans and everything else that a
    labeler may call personal; votes are 1 (personal), 0 (no opinion), -1 (not)."""
    found = base_spans(text)
    taken = [(s, e) for _, s, e, ok in found if ok]
    more = []
    for m in ASSIGNED.finditer(text):
        more.append(("secret", m.start(1), m.end(1)))
    for m in BARE_PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            more.append(("phone", m.start(), m.end()))
    for kind, start, end, ok in found:  # several numbers in one failing match
        if kind == "card" and not ok:
            at = start
            for group in text[start:end].split(" "):
                if 13 <= len(_digits(group)) <= 19 and len(group) < end - start:
                    more.append(("card", at, at + len(group)))
                at += len(group) + 1
    for m in TITLED.finditer(text):
        more.append(("name", m.start(1), m.end(1)))
    # a proposal inside an accepted base span says nothing new
    found += [(k, s, e, False) for k, s, e in more if not any(a <= s and e <= b for a, b in taken)]
    return [(k, s, e, ok, votes(k, text, s, e, ok)) for k, s, e, ok in found]


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    span, before = text[start:end], text[max(0, start - CONTEXT_CHARS):start]
    low, digits = before.lower(), _digits(span)
    if kind == "email":
        shape, check = 1, 1 if len(span) <= 254 else -1
        listed = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif kind == "ip":
        shape, check = (1 if span.count(".") == 3 else -1), (1 if base else -1)
        listed = -1 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        shape, check = (1 if 13 <= len(digits) <= 19 else -1), (1 if luhn(digits) else -1)
        listed = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        shape, check = (1 if span.startswith("+") else -1), (1 if base else 0 if 9 <= len(digits) <= 15 else -1)
        listed = 1 if span.startswith("+") and digits[0] != "0" else 0
    elif kind == "secret":
        key = KEY_BEFORE.search(before[:-1].rstrip(" =:\"'")) if before else None
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        shape, check = (1 if mixed else -1), (1 if len(set(span)) >= 8 else -1)
        listed = 1 if key and any(w in key.group(1).lower() for w in SECRET_WORDS) else -1
    else:
        shape, check = 1, 0
        listed = 1 if span.split(" ")[0].lower() in FIRST_NAMES else -1
    context = 1 if any(w in low for w in CONTEXT[kind]) else 0
    return shape, check, listed, context, (-1 if any(w in low for w in AGAINST) else 0)


def reliabilities(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 50):
    """Expectation-maximisation over counted vote patterns (two classes).

    Returns per kind the prior, per labeler and class the probabilities of its
    votes, and per pattern the probability of being personal. Starts from the
    trusted majority of votes; counts are smoothed, so a labeler that never votes says
    nothing."""
    p = 1 / (1 + np.exp(-1.5 * np.array([v for _, v, _ in patterns], dtype=float).reshape(len(patterns), -1) @ TRUST))
    n = np.array([c for _, _, c in patterns], dtype=float)
    kinds = sorted({k for k, _, _ in patterns})
    which = np.array([kinds.index(k) for k, _, _ in patterns], dtype=int)
    v = np.array([x for _, x, _ in patterns], dtype=int).reshape(len(patterns), -1) + 1
    prior = theta = None
    for _ in range(rounds):
        prior = np.array([(1 + (n * p)[which == k].sum()) / (2 + n[which == k].sum()) for k in range(len(kinds))])
        theta = np.empty((len(kinds), v.shape[1], 2, 3))
        for k in range(len(kinds)):
            for j in range(v.shape[1]):
                for c, w in ((1, n * p), (0, n * (1 - p))):
                    count = np.bincount(v[which == k, j], weights=w[which == k], minlength=3)
                    # weak knowledge: a vote is right more often than wrong
                    right = 4.0 * TRUST[j]
                    soft = count + np.array([1.0, 2.0, right] if c else [right, 2.0, 1.0])
                    theta[k, j, c] = CHECKSUM[c] if LABELERS[j] == "checksum" else soft / soft.sum()
        log = [np.log(theta[which[:, None], np.arange(v.shape[1])[None, :], c, v]).sum(axis=1) for c in (0, 1)]
        odds = np.log(prior[which] / (1 - prior[which])) + log[1] - log[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(kinds, prior)) if prior is not None else {}, theta, p


def _features(kind: str, v: tuple[int, ...]) -> np.ndarray:
    """Kind, and every vote for and against."""
    x = [float(kind == k) for k in KINDS]
    for vote in v:
        x += [float(vote > 0), float(vote < 0)]
    return np.array(x)


def train_classifier(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 60) -> np.ndarray:
    """Weights of a logistic span classifier fitted (ridge, Newton) to the
    probabilities that the labelers' reliabilities imply."""
    if not patterns:
        return np.zeros(len(KINDS) + 2 * len(LABELERS))
    _, _, p = reliabilities(patterns)
    x = np.array([_features(k, v) for k, v, _ in patterns])
    n = np.array([c for _, _, c in patterns], dtype=float)
    n = n / n.sum() * max(len(n), 100)
    n = np.maximum(n, 0.05)  # rare patterns still count
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - q)) - 0.02 * w
        hess = (x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 0.02 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Classifier weights from the vote patterns of all candidates in all texts.
    Only the counts of patterns reach the driver: at most 6 kinds x 3**5."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for part in slices(b):
                for t in part.column(0).to_pylist():
                    for kind, _, _, _, v in candidates(t or ""):
                        seen[kind, v] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([list(v) for _, v in keys], pa.list_(pa.int32())),
             pa.array([seen[k] for k in keys], pa.int64())], ["kind", "votes", "n"])

    rows = (docs.select(text_col).mapInArrow(run, "kind string, votes array<int>, n long")
            .groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect())
    return train_classifier([(r["kind"], tuple(r["votes"]), float(r["n"])) for r in rows])


def spans(text: str, weights: np.ndarray, threshold: float = THRESHOLD):
    """(base spans, all spans), each (kind, start, end), by kind then start."""
    base, every = [], []
    for kind, s, e, ok, v in candidates(text):
        if ok and kind in BASE:
            base.append((kind, s, e))
            every.append((kind, s, e))
        elif 1 / (1 + math.exp(-float(np.clip(_features(kind, v) @ weights, -30, 30)))) >= threshold:
            every.append((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda x: (order[x[0]], x[1], x[2])
    return sorted(base, key=key), sorted(set(every), key=key)


def joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_personal(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of base spans, base_sha256, spans.

    A null or empty text has no spans; null and repeated ids are carried along;
    an empty table gives no rows; only the two columns are read. Whole texts are
    read by patterns that take linear time."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            for part in slices(b):
                counts, digest, every = [], [], []
                for t in part.column(1).to_pylist():
                    base, found = spans(t or "", weights)
                    counts.append([sum(k == x[0] for x in base) for k in BASE])
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    every.append(joined(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)),
                     pa.array(digest, pa.string()), pa.array(every, pa.string())], names)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found) -> str:
    """Each run of overlapping spans becomes the kind of its first one."""
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with every span found replaced by its kind; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for part in slices(b):
                texts = [None if t is None else redacted(t, spans(t, weights)[1]) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal(docs, fit(docs))
