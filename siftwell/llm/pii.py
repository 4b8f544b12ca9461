"""Personal data: exact base patterns, and spans that a linear-chain CRF adds.

Base. Four patterns (email, ip, card, phone) with leftmost, non-overlapping matches per kind;
matches that fail their kind's test (parts, length, Luhn) are dropped and not retried. They are
found from the characters they must hold (an at sign, a digit, a plus) with the same result as
scanning the whole text with the pattern.

CRF. Words carry shape features (their characters' classes with runs cut, lengths, affixes,
neighbours' shapes); labels are B- and I- for each kind and O. Weights are fitted by gradient
ascent on the likelihood of a small labelled table that `labelled_table` makes from a rule, and
the best label sequence is found by Viterbi on numpy batches of equal length. A word that has
no digit, no at sign and no spelled-out one beside it cannot be personal data of these kinds and
is O. With the labels of such words fixed, a chain falls apart between them, so only the
stretches round other words are decoded, with the same result as decoding whole texts.

Words that the CRF labels become a span where the best labels are ahead of the best ones that are
O on just these words by a least margin, and the span has the digits or parts its kind needs and
overlaps no base span. Each span is judged by itself, whatever else its stretch holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
HASH = 1 << 12
#: Words on each side of a stretch that give it context; they are O.
CONTEXT = 2
MARGIN = 1.0
#: Words of stretches that are decoded at once; a longer stretch is decoded alone, and whole.
BATCH_WORDS = 1 << 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, so the run's start suffices (and stays linear).
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\S+")
#: What personal data of these kinds must hold: a digit, an at sign, or one that is spelled out.
_MARK = re.compile(r"[0-9@]|(?i:[\[({<](?:at|dot)[\])}>]|\bat\s+\S{1,40}\s+dot\b)")
_SIGN = re.compile(r"(?i)[\[({<](?:at|dot)[\])}>]|@|at|dot")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`: the local part is the run
    of its characters that ends at an at sign, as far back as the last match allows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- features -------------------------------------------------------------------------------

_CLASSES = [(re.compile(r"[A-Z]"), "A"), (re.compile(r"[a-z]"), "a"), (re.compile(r"[0-9]"), "9"), (re.compile(r"[^\W\d_A-Za-z]"), "x")]


@lru_cache(maxsize=100_000)
def shape(word: str) -> str:
    """Character classes, runs of letters cut to two, runs of digits kept to their length up to 16."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    word = re.sub(r"(A|a|x)\1{2,}", r"\1\1", word)
    return re.sub(r"9{17,}", "9" * 17, word)[:40]


@lru_cache(maxsize=100_000)
def _own(word: str) -> tuple[str, ...]:
    s, digits = shape(word), sum(map(str.isdigit, word))
    short = re.sub(r"(.)\1+", r"\1", s)
    return (f"s={s}", f"r={short}", f"d={min(digits, 17)}", f"n={min(len(word) // 2, 12)}", f"a={'@' in word}", f"p={word.count('.')}", f"+={word[:1] == '+'}", f"w={word.lower().strip('.,;:')[:12] if digits == 0 else '#'}", f"e={s[-1:]}")


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % HASH


@lru_cache(maxsize=200_000)
def _ids(word: str, side: str) -> tuple[int, ...]:
    own = _own(word)
    return tuple(_bucket(f"{side}{f}") for f in (own if side == "0" else (own[1], own[2], own[7])))


def _features(words: list[str]) -> Iterator[np.ndarray]:
    for i, w in enumerate(words):
        ids = list(_ids(w, "0"))
        ids += _ids(words[i - 1], "-") if i else (_bucket("-start"),)
        ids += _ids(words[i + 1], "+") if i + 1 < len(words) else (_bucket("+end"),)
        yield np.array(ids, dtype=np.int64)


def features(words: list[str]) -> list[np.ndarray]:
    """Feature numbers of each word: its own and its neighbours'."""
    return list(_features(words))


# ---- training -------------------------------------------------------------------------------


def labelled_table(rows: int = 360, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: (words, labels), made from a rule with random fillings.

    It holds each kind in its usual spellings, and what looks alike but is no personal data:
    versions, dates, amounts, long identifiers, keys, section numbers.
    """
    random = np.random.default_rng(seed)
    pick = lambda xs: xs[int(random.integers(len(xs)))]
    digits = lambda n: "".join(str(int(d)) for d in random.integers(0, 10, n))
    letters = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[int(i)] for i in random.integers(0, 26, n))
    word = lambda: letters(int(random.integers(2, 9)))

    def email() -> list[str]:
        a, b, c = word(), word(), pick(["com", "org", "net", "example.com", "co"])
        a = pick([a, f"{a}.{digits(2)}", f"{a}_{word()}"])
        return pick([[f"{a}@{b}.{c}"], [a, pick(["[at]", "(at)", "at"]), b, pick(["[dot]", "(dot)", "dot"]), "com"], [a, "@", f"{b}.{c}"], [f"{a}@{b}.{c}"]])

    def ip() -> list[str]:
        return [".".join(str(int(random.integers(1, 256))) for _ in range(4))]

    def card() -> list[str]:
        d = digits(15)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return pick([[d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join([d[:4], d[4:8], d[8:12], d[12:]])]])

    def phone() -> list[str]:
        a, b, c, k = digits(3), digits(3), digits(4), pick(["+1", "+44", "+49", "+33"])
        return pick([[k, f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [k, a, b, c], [f"{k}-{a}-{b}-{c}"], [f"{a}.{b}.{c}"]])

    def other() -> list[str]:
        return pick([
            ["version", f"{pick('123456789')}.{digits(1)}."], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [digits(int(random.integers(1, 7)))], [f"${digits(3)}.{digits(2)}"],
            ["section", f"{digits(1)}.{digits(1)}.{digits(1)}"], [f'"{"".join(pick([digits(1), letters(1)]) for _ in range(32))}"'], [f"{digits(2)}:{digits(2)}:{digits(2)}"], [digits(int(random.integers(20, 28)))],
            [f"{letters(2).upper()}{digits(6)}"], ["at", word()], [word(), "at", "the", word()], ["dot", word()], [f"{digits(2)}%"], ["CC", "BY-NC", f"{digits(1)}.0."], [f"{digits(4)}"], [f"{letters(3)}{digits(2)}"], [digits(8)],
        ])

    made, makers = [], {"email": email, "ip": ip, "card": card, "phone": phone}
    for k in range(rows):
        words, labels = [], []
        for _ in range(int(random.integers(1, 4))):
            n = int(random.integers(1, 6))
            words += [word() for _ in range(n)]
            labels += ["O"] * n
            kind = pick([*KINDS, "", ""])
            own = makers[kind]() if kind else other()
            own[-1] += pick(["", "", ".", ",", "!!"]) if kind else ""
            words += own
            labels += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(own))]
        words.append(word())
        labels.append("O")
        made.append((words, labels))
    return made


class Crf:
    """Emission weights by feature and label, transition weights by label pair."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores, with O forced on words that cannot be personal data."""
        out = np.empty((len(words), len(LABELS)))
        for i, ids in enumerate(_features(words)):
            out[i] = self.emission[ids].sum(axis=0)
        for i, w in enumerate(words):
            if not re.search(r"[0-9@]", w) and not _spelled(words, i):
                out[i, 1:] = -1e6
        return out

    def decode(self, batch: np.ndarray) -> tuple[np.ndarray, "Leads"]:
        """Viterbi over (sequences, words, labels): best labels, and what they are ahead of O by."""
        start = batch[:, 0, :].copy()
        start[:, [i for i, name in enumerate(LABELS) if name[0] == "I"]] -= 1e6
        best, back, into = start, [], [np.zeros(len(batch))]
        for t in range(1, batch.shape[1]):
            step = best[:, :, None] + self.transition[None]
            back.append(step.argmax(axis=1).astype(np.int8))
            top = step.max(axis=1)
            into.append(top[:, 0])
            best = top + batch[:, t, :]
        path = [best.argmax(axis=1)]
        for pointers in reversed(back):
            path.append(pointers[np.arange(len(pointers)), path[-1]])
        after = [np.zeros_like(start)]
        for t in range(batch.shape[1] - 1, 0, -1):
            after.append((self.transition[None] + (batch[:, t, :] + after[-1])[:, None, :]).max(axis=2))
        out = np.stack([a[:, 0] for a in reversed(after)], axis=1)
        return np.stack(path[::-1], axis=1), Leads(best.max(axis=1), np.stack(into, axis=1), np.cumsum(batch[:, :, 0], axis=1), out, float(self.transition[0, 0]))


class Leads:
    """How far the best labels of sequences are ahead of the best ones that are O in a span."""

    def __init__(self, best: np.ndarray, into: np.ndarray, none: np.ndarray, out: np.ndarray, stay: float):
        self.best, self.into, self.none, self.out, self.stay = best, into, none, out, stay

    def of(self, s: int, t: int, u: int) -> float:
        """For words `t` to `u` (exclusive) of sequence `s`."""
        words = self.none[s, u - 1] - (self.none[s, t - 1] if t else 0.0) + self.stay * (u - t - 1)
        return float(self.best[s] - (self.into[s, t] + words + self.out[s, u - 1]))


def _spelled(words: list[str], i: int) -> bool:
    """A sign, or a word beside one, may be part of an address."""
    return any(_SIGN.fullmatch(w) for w in words[max(0, i - 1) : i + 2])


def _allowed() -> np.ndarray:
    """Minus a lot where a label may not follow: I-x only after B-x or I-x."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, after in enumerate(LABELS):
        if after[0] == "I":
            for i, before in enumerate(LABELS):
                if before[2:] != after[2:]:
                    out[i, j] = -1e6
    return out


@lru_cache(maxsize=1)
def train(steps: int = 60, rate: float = 0.4, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a weak prior, AdaGrad over the whole labelled table."""
    table = labelled_table()
    lengths = [len(w) for w, _ in table]
    longest, n, labels = max(lengths), len(table), len(LABELS)
    feats = [features(w) for w, _ in table]
    flat_ids = np.concatenate([ids for f in feats for ids in f])
    row_of = np.concatenate([np.full(len(ids), s * longest + t) for s, f in enumerate(feats) for t, ids in enumerate(f)])
    gold = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    for s, (_, names) in enumerate(table):
        gold[s, : len(names)] = [LABELS.index(x) for x in names]
        mask[s, : len(names)] = True
    emission, transition, barred = np.zeros((HASH, labels)), np.zeros((labels, labels)), _allowed()
    ge, gt = np.full_like(emission, 1e-3), np.full_like(transition, 1e-3)
    first = np.where([x[0] == "I" for x in LABELS], -1e6, 0.0)
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(steps):
        u = np.zeros((n * longest, labels))
        np.add.at(u, row_of, emission[flat_ids])
        u = u.reshape(n, longest, labels)
        move = transition + barred
        alpha = [u[:, 0] + first]
        for t in range(1, longest):
            step = lse(alpha[-1][:, :, None] + move[None], 1) + u[:, t]
            alpha.append(np.where(mask[:, t, None], step, alpha[-1]))
        beta = [np.zeros((n, labels))]
        for t in range(longest - 1, 0, -1):
            step = lse(move[None] + (u[:, t] + beta[-1])[:, None, :], 2)
            beta.append(np.where(mask[:, t, None], step, beta[-1]))
        beta = beta[::-1]
        total = lse(alpha[-1], 1)
        marginal = np.zeros((n, longest, labels))
        pair = np.zeros((labels, labels))
        for t in range(longest):
            marginal[:, t] = np.exp(alpha[t] + beta[t] - total[:, None]) * mask[:, t, None]
            if t:
                p = np.exp(alpha[t - 1][:, :, None] + move[None] + (u[:, t] + beta[t])[:, None, :] - total[:, None, None])
                pair += (p * mask[:, t, None, None]).sum(axis=0)
        wrong = marginal.copy()
        s, t = np.nonzero(mask)
        wrong[s, t, gold[s, t]] -= 1
        d_emission = np.zeros_like(emission)
        np.add.at(d_emission, flat_ids, wrong.reshape(-1, labels)[row_of])
        d_emission += decay * n * emission
        np.subtract.at(pair, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        pair += decay * n * transition
        ge += d_emission**2
        gt += pair**2
        emission -= rate * d_emission / np.sqrt(ge)
        transition -= rate * pair / np.sqrt(gt)
    return Crf(emission, transition + barred)


# ---- tagging --------------------------------------------------------------------------------


def _stretches(text: str, base: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """Word spans of the stretches that hold a mark outside the base spans, with context on both
    sides; a stretch whose marks all lie in base spans has nothing to add."""
    marks = [m.span() for m in _MARK.finditer(text)]
    if base:
        starts = np.array([s for s, _, _ in base])
        reach = np.maximum.accumulate(np.array([e for _, e, _ in base]))
        at = np.array([m[0] for m in marks])
        k = np.searchsorted(starts, at, side="right") - 1
        marks = [m for m, i, a in zip(marks, k, at) if i < 0 or reach[i] <= a]
    if not marks:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    ends = np.array([b for _, b in words])
    first = np.searchsorted(ends, [a for a, _ in marks], side="right")
    last = np.searchsorted(ends, [b for _, b in marks], side="left")
    wanted = sorted({i for a, b in zip(first.tolist(), last.tolist()) for i in range(a, b + 1)})
    out: list[list[tuple[int, int]]] = []
    i = 0
    while i < len(wanted):
        j = i
        while j + 1 < len(wanted) and wanted[j + 1] - wanted[j] <= 2 * CONTEXT:
            j += 1
        out.append(words[max(0, wanted[i] - CONTEXT) : wanted[j] + CONTEXT + 1])
        i = j + 1
    return out


_TRIM = " \t\n.,;:!?\"'%$&#*"


def _accepts(kind: str, piece: str) -> bool:
    """What a span of each kind must at least have."""
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return ("@" in piece or re.search(r"(?i)\bat\b", piece) is not None) and re.search(r"(?i)\.|\bdot\b", piece) is not None
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)
    if kind == "card":
        d = _NOT_DIGIT.sub("", piece)
        return 13 <= digits <= 19 and re.fullmatch(r"[0-9 -]+", piece) is not None and luhn(d)
    return 10 <= digits <= 15 and re.fullmatch(r"[+0-9 ().-]+", piece) is not None


def all_spans(texts: list[str], model: Crf) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each whole text its base spans, and all spans (base ones and those the CRF adds)."""
    base = [base_spans(t) for t in texts]
    jobs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for k, text in enumerate(texts):
        for words in _stretches(text, base[k]):
            jobs.setdefault(len(words), []).append((k, words))
    added: dict[int, list[tuple[int, int, str]]] = {}
    for length, group in jobs.items():
        rows = max(1, BATCH_WORDS // length)
        for i in range(0, len(group), rows):
            some = group[i : i + rows]
            paths, lead = model.decode(np.stack([model.scores([texts[k][a:b] for a, b in words]) for k, words in some]))
            for row, ((k, words), path) in enumerate(zip(some, paths)):
                t = 0
                while t < length:
                    name = LABELS[path[t]]
                    if name[0] != "B":
                        t += 1
                        continue
                    u = t + 1
                    while u < length and LABELS[path[u]] == f"I-{name[2:]}":
                        u += 1
                    a, b = words[t][0], words[u - 1][1]
                    while b > a and texts[k][b - 1] in _TRIM:
                        b -= 1
                    while a < b and texts[k][a] in _TRIM:
                        a += 1
                    if b > a and lead.of(row, t, u) >= MARGIN and _accepts(name[2:], texts[k][a:b]) and not any(s < b and a < e for s, e, _ in base[k]):
                        added.setdefault(k, []).append((a, b, name[2:]))
                    t = u
    return [(own, sorted({*own, *added.get(k, [])}, key=lambda s: (s[0], KINDS.index(s[2])))) for k, own in enumerate(base)]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for every row.

    Null counts as the empty text, which has no span. Places are code points, ends exclusive.
    Repeated rows give repeated rows; an empty table gives none.
    """
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                got = all_spans([t or "" for t in batch.column(1).to_pylist()], model)
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in got], pa.int64()) for kind in KINDS]
                digests = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in got])
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_listed(s) for _, s in got], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """`docs` with all spans of `text` masked; every other column and null texts stay."""
    from siftwell.llm.rewrite import map_texts

    model = model or train()
    return map_texts(docs, lambda texts: [mask(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, model))])
