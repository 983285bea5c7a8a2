"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Four kinds are looked for. Spans of the fixed base patterns always count. Loose searches propose further candidates:
numbers that touch others (the base patterns swallow or drop these), other separators, spelled-out mail addresses.
What defines a kind holds for proposals too: Luhn's check for cards, parts up to 255, 8 to 15 digits of a phone.
Seven labelers vote yes, no or nothing on each candidate: three from regular expressions, one from gazetteers, three from context.
How often each pattern of votes occurs is counted over all documents. Expectation-maximisation on these counts
estimates, per kind, how labelers vote on true and on false spans, and so how likely each pattern is true. With these
likelihoods as soft labels a logistic span classifier is trained on votes and shape. Its spans of 0.5 or more are
added, the surest first, where they overlap nothing.

Patterns are few (``7 votes of 3 values x 8 shapes x 4 kinds`` at most), so the driver only sees counts of a fixed size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("exact", "loose", "plausible", "known", "cue", "edges", "alone")
SHAPES = 8

#: How a better than random labeler votes (no, nothing, yes) on a false and on a true span, and the weight of this belief in spans.
PRIOR = np.array([[0.6, 0.3, 0.1], [0.1, 0.2, 0.7]])
PRIOR_SPANS = 20.0
EM_ROUNDS = 100
RIDGE = 1.0

# Fixed values of the base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BASE_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
BASE_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
BASE_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and cue words, fixed values.
ENDINGS = frozenset("com org net edu gov mil int info biz name dev app io ai co me tv eu de at ch fr be nl lu es pt it uk ie us ca mx ar br cl pe au nz in jp cn kr ru pl cz se no dk fi gr tr za".split())
CUES = {
    EMAIL: frozenset("mail email mails courriel correo contact kontakt contacto write schreiben escribe".split()),
    IP: frozenset("ip ipv4 ipv6 host server client address adresse peer login from".split()),
    CARD: frozenset("card cards visa mastercard amex credit debit karte kreditkarte tarjeta carte pan".split()),
    PHONE: frozenset("tel phone telephone telefon teléfono téléphone mobile cell fax call whatsapp handy móvil portable appelez llame anrufen".split()),
}
AGAINST = frozenset("token key secret hash sha md5 uuid guid isbn issn doi version build order invoice sku serial id".split())
#: Words that stand before "at" in a sentence, not in an address.
SMALL_WORDS = frozenset("me us him her them it is are was be meet look looking arrive arrived found available here there".split())

#: An at sign or its spelling, and what may follow it as a domain.
AT = re.compile("[@＠]|[Aa](?:[Tt]|[Rr][Rr][Oo][Bb][Aa])(?![A-Za-z0-9])")
LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})")
DOT = re.compile(r"\s{0,2}[\[({<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}>]\s{0,2}|\s{1,2}(?:dot|punto|punkt|point)\s{1,2}|\s\.\s|\.", re.I)
_SEP = r"(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s|\s\.\s|\.)"
IP4 = re.compile(r"(?<![0-9])[0-9]{1,3}(?:" + _SEP + r"[0-9]{1,3}){3}(?![0-9])", re.I)
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
#: Digit groups with what may stand between the groups of one number; a zone is a chain of them.
GROUP = re.compile("[0-9]++")
BETWEEN = re.compile("[ \\t\\n\\u00a0().+/\\u2010-\\u2015-]{1,3}")
WORD = re.compile(r"[^\W\d_]+[0-9]?")
#: Groups of one number at most, digits of one number at most.
GROUPS_AT_MOST = 8
DIGITS_AT_MOST = 19
CUE_CHARS = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start. Linear in the text, however its runs look."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((EMAIL, start, end))
        at = text.find("@", max(at + 1, end))
    out += [(IP, m.start(), m.end()) for m in BASE_IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in BASE_CARD.finditer(text):
        if 16 <= len(m.group()) and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    out += [(PHONE, m.start(), m.end()) for m in BASE_PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# -- votes shared by all kinds ---------------------------------------------------------------------------------------


def _cue(text: str, start: int, kind: int) -> int:
    """The nearest cue word before the span on its line, for or against."""
    left = text[max(0, start - CUE_CHARS) : start].rsplit("\n", 1)[-1].lower()
    for word in reversed(WORD.findall(left)):
        if word in CUES[kind]:
            return 1
        if word in AGAINST:
            return -1
    return 0


def _edges(text: str, start: int, end: int) -> int:
    """No, if a letter or digit touches the span; nothing beside a quote or an equals sign."""
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    if any(c.isalnum() or c == "_" for c in around):
        return -1
    return 0 if any(c in "\"'=:#" for c in around) else 1


def _sign(yes: bool) -> int:
    return 1 if yes else -1


Candidate = tuple[int, int, int, tuple[int, ...]]


def _candidate(text: str, kind: int, start: int, end: int, exact: int, loose: int, valid: int, known: int, alone: int) -> Candidate:
    return kind, start, end, (exact, loose, valid, known, _cue(text, start, kind), _edges(text, start, end), alone)


# -- proposals of each kind ------------------------------------------------------------------------------------------


def _emails(text: str) -> Iterator[Candidate]:
    for m in AT.finditer(text):
        left, right, spelled = m.start(), m.end(), m.group() not in "@＠"
        if spelled and left and text[left - 1].isalnum():
            continue
        while left and m.start() - left < 2 and text[left - 1].isspace():
            left -= 1
        while right < len(text) and right - m.end() < 2 and text[right].isspace():
            right += 1
        bracket = 0 < left and right < len(text) and text[left - 1] + text[right] in ("[]", "()", "{}", "<>")
        if bracket:
            left, right = left - 1, right + 1
            for _ in range(2):
                left -= bool(left and text[left - 1].isspace())
                right += bool(right < len(text) and text[right].isspace())
        if spelled and not bracket and (left == m.start() or right == m.end()):
            continue
        start = left
        while start and left - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        label = LABEL.match(text, right)
        if start == left or not label:
            continue
        end, labels, worded = 0, [label.group()], bracket or spelled
        while (dot := DOT.match(text, label.end())) and (label := LABEL.match(text, dot.end())):
            worded_dot = dot.group().strip() != "."
            if spelled and not bracket and not worded_dot:
                break
            labels.append(label.group())
            worded |= worded_dot
            end = label.end()
        if not end:
            continue
        gap = not bracket and not spelled and (left != m.start() or right != m.end())
        last, local = labels[-1].lower(), text[start:left]
        valid = last.isalpha() and 2 <= len(last) <= 24 and ".." not in local and not labels[0].endswith("-")
        plain = text[start:end] == f"{local}@{'.'.join(labels)}"
        loose = int(not gap)
        small = local.lower() in SMALL_WORDS
        yield _candidate(text, EMAIL, start, end, _sign(plain and valid) if not worded else 0, loose, _sign(valid), _sign(last in ENDINGS), -1 if small else int(not spelled or bracket))


def _ips(text: str) -> Iterator[Candidate]:
    for m in IP4.finditer(text):
        parts, seps = GROUP.findall(m.group()), [s for s in re.split("[0-9]+", m.group()) if s]
        plain, same = set(seps) == {"."}, len(set(seps)) == 1
        if any(int(p) > 255 for p in parts):
            continue
        chained = bool(re.match(r"\s?[.,][0-9]", text[m.end() : m.end() + 3])) or bool(re.search(r"[0-9][.,]\s?$", text[max(0, m.start() - 3) : m.start()]))
        exact = _sign(all(p == "0" or p[0] != "0" for p in parts)) if plain else 0
        special = int(parts[0]) in (0, 127, 255)
        yield _candidate(text, IP, m.start(), m.end(), exact, _sign(same), _sign(not special), _sign(1 <= int(parts[0]) <= 223), _sign(not chained))
    if ":" in text:
        for m in IP6.finditer(text):
            groups = [g for g in m.group().split(":") if g]
            whole = "::" not in m.group()
            letters = any(c.isalpha() for c in m.group())
            yield _candidate(text, IP, m.start(), m.end(), _sign(whole or letters), _sign(len(groups) >= 3), _sign(len(groups) > 1), _sign(groups[0][0] in "23fF"), 1)


def _zones(text: str) -> Iterator[list[re.Match]]:
    """Chains of digit groups with nothing but separators between neighbours."""
    chain: list[re.Match] = []
    for m in GROUP.finditer(text):
        if chain and not BETWEEN.fullmatch(text, chain[-1].end(), m.start()):
            yield chain
            chain = []
        chain.append(m)
    if chain:
        yield chain


def _known_card(d: str) -> bool:
    two, three, four = int(d[:2]), int(d[:3]), int(d[:4])
    return d[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two in (34, 36, 37, 38, 65) or four == 6011 or 300 <= three <= 305 or 644 <= three <= 649 or 3528 <= four <= 3589


def _known_code(digits: str) -> bool:
    """Country calling codes: one digit in zones 1 and 7, two digits for the listed ones, three in the other assigned tens."""
    if digits[0] in "17":
        return True
    two = int(digits[:2])
    ranges = ((30, 34), (43, 49), (51, 58), (60, 66), (90, 95))
    if two in (20, 27, 36, 39, 40, 41, 81, 82, 84, 86, 98) or any(a <= two <= b for a, b in ranges):
        return True
    return two in (21, 22, 23, 24, 25, 26, 29, 35, 37, 38, 42, 50, 59, 67, 68, 69, 80, 85, 87, 88, 96, 97, 99)


CARD_LAYOUTS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}
NATIONAL = (3, 3, 4)


def _numbers(text: str) -> Iterator[Candidate]:
    for zone in _zones(text):
        if len(zone) == 1 and zone[0].end() - zone[0].start() < 7:
            continue
        for i, first in enumerate(zone):
            lengths: list[int] = []
            for j in range(i, min(len(zone), i + GROUPS_AT_MOST)):
                lengths.append(zone[j].end() - zone[j].start())
                total = sum(lengths)
                if total > DIGITS_AT_MOST:
                    break
                alone = int((i == 0 or zone[i - 1].end() + 1 < first.start() and text[first.start() - 1] in "+(") and j == len(zone) - 1)
                digits = "".join(m.group() for m in zone[i : j + 1])
                if total >= 13 and (len(lengths) == 1 or tuple(lengths) in CARD_LAYOUTS) and luhn(digits):
                    seps = {text[a.end() : b.start()] for a, b in zip(zone[i:j], zone[i + 1 : j + 1])}
                    usual = total == 16 or total == 15 and digits[:2] in ("34", "37")
                    yield _candidate(text, CARD, first.start(), zone[j].end(), _sign(usual), _sign(len(seps) <= 1), _sign(len(set(digits)) > 2), _sign(_known_card(digits)), alone)
                if 8 <= total <= 15:
                    yield from _phone(text, zone[i : j + 1], tuple(lengths), total, alone)


def _phone(text: str, groups: list[re.Match], lengths: tuple[int, ...], total: int, alone: int) -> Iterator[Candidate]:
    start, end = groups[0].start(), groups[-1].end()
    opened = start > 0 and text[start - 1] == "("
    plus = start > 0 and text[start - 1] == "+" or text[max(0, start - 2) : start] == "+("
    zeros = not plus and groups[0].group().startswith("00") and len(groups) > 1
    inner = text[start:end]
    national = not plus and lengths == NATIONAL and (opened or inner[3] == inner[7] in "-.")
    cued = not plus and len(groups) > 1 and _cue(text, start, PHONE) == 1
    if not (plus or zeros or national or cued):
        return
    start -= opened + plus
    depth = inner.count("(") + opened - inner.count(")")
    digits = "".join(m.group() for m in groups)
    tidy = depth == 0 and "+" not in inner and "\n" not in inner.replace("\n", "", 1)
    full = plus and lengths[0] == 1 and digits[0] == "1" and (lengths == (1, 3, 3, 4) or lengths == (11,))
    known = _sign(_known_code(digits)) if plus else _sign(len(digits) > 4 and _known_code(digits[2:])) if zeros else 0
    yield _candidate(text, PHONE, start, end, 1 if full else 0 if plus or national else -1, _sign(tidy), _sign(len(set(digits)) > 2), known, alone)


def candidates(text: str) -> Iterator[Candidate]:
    yield from _emails(text)
    yield from _ips(text)
    yield from _numbers(text)


def pattern_of(text: str, c: Candidate) -> int:
    """Kind, votes and shape (white space, brackets, length) of a candidate as one number."""
    kind, start, end, votes = c
    inner = text[start:end]
    shape = any(ch.isspace() for ch in inner) + 2 * any(ch in "()[]{}<>" for ch in inner) + 4 * (end - start > 24)
    number = kind
    for v in votes:
        number = number * 3 + v + 1
    return number * SHAPES + shape


def unpack(pattern: int) -> tuple[int, np.ndarray, int]:
    """(kind, votes as 0, 1, 2, shape) of a pattern number."""
    number, shape = divmod(pattern, SHAPES)
    votes = []
    for _ in LABELERS:
        number, v = divmod(number, 3)
        votes.append(v)
    return number, np.array(votes[::-1]), shape


# -- the label model and the classifier ------------------------------------------------------------------------------


@dataclass
class Model:
    """Per kind: how labelers vote on false and true spans, and the weights of the span classifier."""

    votes: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def score(self, pattern: int) -> float:
        kind, votes, shape = unpack(pattern)
        return float(_logistic(_features(votes[None], np.array([shape])) @ self.weights[kind])[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    bits = np.stack([(shape >> b) & 1 for b in range(3)], axis=1)
    return np.concatenate([np.ones((len(votes), 1)), votes == 2, votes == 0, bits], axis=1).astype(float)


def reliabilities(votes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: (how each labeler votes on false and true spans, how likely each row of votes is true)."""
    table = np.repeat(PRIOR[None], votes.shape[1], axis=0)
    share = 0.5
    places = np.arange(votes.shape[1])
    true = np.zeros(len(votes))
    for _ in range(EM_ROUNDS):
        likelihood = np.log(table[places[None], :, votes]).sum(axis=1) + np.log([1 - share, share])
        before, true = true, _logistic(likelihood[:, 1] - likelihood[:, 0])
        weight = np.stack([(1 - true) * count, true * count])
        share = (weight[1].sum() + PRIOR_SPANS / 2) / (count.sum() + PRIOR_SPANS)
        for v in range(3):
            table[:, :, v] = PRIOR[:, v] * PRIOR_SPANS + np.einsum("yn,nl->ly", weight, votes == v)
        table /= table.sum(axis=2, keepdims=True)
        if np.abs(true - before).max(initial=0.0) < 1e-9:
            break
    return table, true


def span_classifier(x: np.ndarray, true: np.ndarray, count: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps with a ridge towards ``belief``."""
    w = belief.copy()
    for _ in range(50):
        p = _logistic(x @ w)
        grad = x.T @ (count * (p - true)) + RIDGE * (w - belief)
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(counts: Iterable[tuple[int, int]]) -> Model:
    """The model from (pattern, spans) counts. Kinds without candidates keep the prior belief."""
    model, found = Model(), [(*unpack(p), n) for p, n in sorted(counts)]
    odds = np.log(PRIOR[1] / PRIOR[0])
    belief = np.concatenate([[len(LABELERS) * odds[1]], np.full(len(LABELERS), odds[2] - odds[1]), np.full(len(LABELERS), odds[0] - odds[1]), np.zeros(3)])
    for kind in range(len(KINDS)):
        mine = [r for r in found if r[0] == kind]
        if not mine:
            model.votes[kind], model.weights[kind] = np.repeat(PRIOR[None], len(LABELERS), axis=0), belief
            continue
        votes, shape, count = np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), np.array([float(r[3]) for r in mine])
        model.votes[kind], true = reliabilities(votes, count)
        model.weights[kind] = span_classifier(_features(votes, shape), true, count, belief)
    return model


# -- the operator ----------------------------------------------------------------------------------------------------

FOUND = "array<struct<kind:int,start:long,end:long,pattern:long>>"
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for text in texts:
            text = text or ""
            rows = [(k, s, e, -1) for k, s, e in base_spans(text)]
            rows += [(c[0], c[1], c[2], pattern_of(text, c)) for c in candidates(text)]
            out.append([{"kind": k, "start": s, "end": e, "pattern": p} for k, s, e, p in rows])
        yield pd.Series(out, dtype=object)


def scan(docs: DataFrame, text: str = "text", name: str = "found") -> DataFrame:
    """Add the base spans (pattern -1) and the candidates of each text with their patterns of votes."""
    return docs.withColumn(name, F.pandas_udf(_scan, FOUND)(F.col(text)))


def train(scanned: DataFrame, name: str = "found") -> Model:
    """Learn from the candidates of all documents. Only counts per pattern come to the driver."""
    each = scanned.select(F.explode(name).alias("f")).where(F.col("f.pattern") >= 0)
    return fit([(r["pattern"], r["n"]) for r in each.groupBy("f.pattern").agg(F.count(F.lit(1)).alias("n")).collect()])


def choose(found: list[tuple[int, int, int, int]], score: dict[int, float]) -> list[tuple[int, int, int, bool, float]]:
    """Base spans, and candidates of 0.5 or more, surest first, longer ones first of equals, that overlap nothing."""
    out = [(k, s, e, True, 1.0) for k, s, e, p in found if p < 0]
    taken: list[tuple[int, int]] = []
    for k, s, e, _, _ in sorted(out, key=lambda r: r[1:3]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    likely = {(k, s, e): score[p] for k, s, e, p in found if p >= 0 and score[p] >= 0.5}
    for (k, s, e), chance in sorted(likely.items(), key=lambda r: (-r[1], r[0][1] - r[0][2], r[0][1], r[0][0])):
        at = bisect_left(taken, (s, e))
        if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
            insort(taken, (s, e))
            out.append((k, s, e, False, chance))
    return sorted(out)


def _resolve(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score: dict[int, float] = {}
        for rows in batches:
            out = []
            for found in rows:
                spans = [(r["kind"], r["start"], r["end"], r["pattern"]) for r in (found if found is not None else [])]
                score.update({p: model.score(p) for p in {r[3] for r in spans} if p >= 0 and p not in score})
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": c} for k, s, e, b, c in choose(spans, score)])
            yield pd.Series(out, dtype=object)

    return run


def resolve(scanned: DataFrame, model: Model, name: str = "found", into: str = "spans") -> DataFrame:
    """Replace the scanned column by the spans that stay: kind, start, end (code points, end exclusive), base, score."""
    chosen = F.pandas_udf(_resolve(model), SPANS)(F.col(name))
    return scanned.withColumn(name, chosen).withColumnRenamed(name, into)


def personal_data(docs: DataFrame, text: str = "text", model: Model | None = None, into: str = "spans") -> DataFrame:
    """Every row with its ``spans``, by kind, then start. Without a model one is trained on these documents first.

    A NULL or empty text has no spans; texts of any length are read whole. Repeated rows and NULL ids are rows like any other and
    count in training. A column named as the result is replaced, all others stay. An empty table gives an empty result.
    """
    docs = docs.drop(into)
    name = fresh(docs, "_found")
    model = model or train(scan(docs.select(text), text, name), name)
    return resolve(scan(docs, text, name), model, name, into)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, rows in batches:
        out = []
        for text, spans in zip(texts, rows):
            if text is None or spans is None:
                out.append(text)
                continue
            pieces, end = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= end:
                    pieces += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
                end = max(end, s["end"])
            out.append("".join(pieces) + text[end:])
        yield pd.Series(out, dtype=object)


def redact(found: DataFrame, text: str = "text", spans: str = "spans", into: str = "redacted") -> DataFrame:
    """The text with each span replaced by its kind in brackets; of overlapping spans one bracket for all they cover."""
    return found.withColumn(into, F.pandas_udf(_mask, "string")(F.col(text), F.col(spans)))
