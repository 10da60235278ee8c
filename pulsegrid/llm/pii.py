"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns (e-mail, IP address, payment card, phone) always hold. Around other signs of such data (digits, at signs, spelled-out
dots, a spelled-out "at" before a dotted name) the field scores whole segments of up to ``MAX_ATOMS`` atoms by features of the span: its shape, digits, checksum, cue words,
neighbours. Dynamic programming over the atoms, with entities of bounded length, picks boundaries and kinds together; spans
that patterns found are walls it cannot cross. An entity must win by ``MARGIN``.

The weights are learned from a bounded sample: ``max_islands`` snippets out of at most ``max_docs`` documents (expected, by hash),
whose labels are the patterns' own spans, and spellings of those spans that the patterns do not know (``spellings``). Finding
then covers every whole text where it lies, without a shuffle.

Defined results: a null text counts as empty and has no spans; a text without any sign of personal data has none either. A sample
without spans teaches nothing, and the patterns stand alone. Repeated rows are searched one by one; an empty table gives an
empty table. ``base`` and ``spans`` replace columns of those names; all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import lean

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, MAX_CHARS = 15, 80
CUED, REACH = 3, 240  # atoms before a segment whose cue words count; characters about a sign that are read, well over MAX_CHARS
MARGIN = 1.0
PIECE, SLICE, AT_ONCE = 2 * MAX_ATOMS + 1, 512, 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGN = re.compile(r"[0-9]+|@")
_DOT = re.compile(r"[dD][oO][tT](?<![^\W\d_]...)(?![^\W\d_])")
_AT = re.compile(r"[aA][tT](?<![^\W\d_]..)(?![^\W\d_])[^\S\n]?[\])}>]?[^\S\n]{0,2}[^\W_][\w-]{0,62}(?:[\[({<]?\.[\])}>]?[^\W_][\w-]{0,62})")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\S")

# Words that announce a kind of personal data.
CUES = {"email": "email mail e write contact correo courriel", "ip": "ip host address server addr adresse", "card": "card visa credit karte carte tarjeta",
        "phone": "phone tel call fon telefon mobile téléphone teléfono"}
_CUE = {w: kind for kind, line in CUES.items() for w in line.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, ordered. Every pattern is matched in linear time, however long the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free, 0))
        else:
            free = at + 1
        at = text.find("@", free)
    if _has_digit(text):
        for m in _NUMBERS.finditer(text):
            if text.find(".", m.start(), m.end()) < 0:
                continue
            parts, begin = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                end = begin + sum(map(len, parts[i:i + 4])) + 3
                if all(map(octet, parts[i:i + 4])):
                    out.append((begin, end, 1))
                begin = end + 1
        for m in _CARD.finditer(text):
            number = digits_of(m.group())
            if 12 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


_has_digit = re.compile("[0-9]").search


# ---- segments and their features ---------------------------------------------------------------------------------

@dataclass
class Island:
    """Atoms of a stretch of text around signs of personal data."""
    atoms: list[tuple[int, int, str]]  # start, end, kind: d digits, a letters, else the character
    marked: list[bool]  # atoms that are signs


def signs(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of digits, at signs, spelled-out dots, and spelled-out "at" before a dotted name, ordered."""
    out = [m.span() for m in _SIGN.finditer(text)]
    spelled = [m.span() for m in _DOT.finditer(text)] + [(m.start(), m.start() + 2) for m in _AT.finditer(text)]
    return sorted(out + spelled) if spelled else out


def stretches(text: str, walls: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, set[int]]]:
    """(start, end, starts of the signs): ``REACH`` characters about every sign outside the walls, joined where they meet; walls and
    line ends part stretches. Linear in the text: signs and walls are passed once, in order."""
    w, floor = 0, 0
    low, high, inside = 0, -1, set()
    for a, b in signs(text):
        while w < len(walls) and walls[w][0] <= a:
            floor = max(floor, walls[w][1])
            w += 1
        if a < floor:
            continue
        top = min(walls[w][0] if w < len(walls) else len(text), b + REACH)
        end = text.find("\n", a, top)
        first = max(floor, a - REACH, text.rfind("\n", max(0, a - REACH), a) + 1)
        if first > high:
            if inside:
                yield low, high, inside
            low, inside = first, set()
        high = end if end >= 0 else top
        inside.add(a)
    if inside:
        yield low, high, inside


def islands(text: str, walls: list[tuple[int, int, int]]) -> Iterator[Island]:
    """The atoms about every sign: all that a segment with the sign can hold, and those that its features look at. Neighbourhoods that meet
    are one island, so no segment crosses an island's edge."""
    for low, high, inside in stretches(text, walls):
        atoms = [(m.start(), m.end(), "d" if m.group()[0] in "0123456789" else "a" if m.group()[0].isalpha() else m.group()[0])
                 for m in _ATOM.finditer(text, low, high)]
        marked = [a in inside for a, _, _ in atoms]
        first, last = 0, -1
        for here in [k for k, is_sign in enumerate(marked) if is_sign]:
            if here - MAX_ATOMS - CUED > last:
                if last >= 0:
                    yield Island(atoms[first:last], marked[first:last])
                first = max(0, here - MAX_ATOMS - CUED)
            last = min(len(atoms), here + MAX_ATOMS + 1)
        if last >= 0:
            yield Island(atoms[first:last], marked[first:last])


def candidates(text: str, island: Island) -> Iterator[tuple[int, int]]:
    """Segments that may be entities (first atom, one after the last), ordered."""
    atoms, marked = island.atoms, island.marked
    for i, (start, _, kind) in enumerate(atoms):
        if kind not in "ad+(":
            continue
        has_sign = False
        for j in range(i, min(i + MAX_ATOMS, len(atoms))):
            if j > i and atoms[j][0] - atoms[j - 1][1] > 2 or atoms[j][1] - start > MAX_CHARS:
                break
            has_sign |= marked[j]
            if has_sign and atoms[j][2] in "ad)":
                yield i, j + 1


def bucket(n: int, edges: Iterable[int]) -> int:
    return sum(n >= e for e in edges)


def features(text: str, island: Island, segment: tuple[int, int]) -> list[str]:
    """Features of a segment as a whole."""
    i, j = segment
    atoms = island.atoms[i:j]
    span = text[atoms[0][0]:atoms[-1][1]]
    number = digits_of(span)
    kinds = "".join(k for _, _, k in atoms)
    lower = [text[a:b].lower() for a, b, _ in atoms]
    groups = [text[a:b] for a, b, k in atoms if k == "d"]
    ats, dots = lower.count("@") + lower.count("at"), lower.count(".") + lower.count("dot")
    shape = re.sub(r"(.)\1+", r"\1", kinds.replace("@", "A"))
    out = ["bias", f"digits{bucket(len(number), (1, 4, 9, 12, 16, 17, 20))}", f"groups{min(len(groups), 6)}", f"atoms{bucket(len(atoms), (2, 4, 6, 8, 11))}",
           f"ats{min(ats, 2)}", f"dots{min(dots, 5)}", f"ats{min(ats, 2)}dots{min(dots, 3)}", f"first{kinds[0]}", f"last{kinds[-1]}",
           f"letters{'a' in kinds}ats{min(ats, 2)}", f"shape {shape[:16]}"]
    joints = {"at", "dot", "@", ".", *"[](){}<>"}
    free = sum(atoms[k + 1][0] > atoms[k][1] and lower[k] not in joints and lower[k + 1] not in joints for k in range(len(atoms) - 1))
    out.append(f"free{min(free, 3)}letters{'a' in kinds}")
    odd = set(kinds) - set("ad@.()[]+-_%")
    if odd:
        out.append("odd")
    if 12 <= len(number) <= 19 and "a" not in kinds:
        out.append(f"luhn{luhn(number)}")
    if len(groups) == 4 and "a" not in kinds and dots >= 3:
        out.append(f"octets{all(map(octet, groups))}")
    if 9 <= len(number) <= 15 and "a" not in kinds:
        out.append(f"phone{kinds[0] == '+' or number.startswith('00')}")
    if ats == 1 and dots:
        where = max(k for k, w in enumerate(lower) if w in ("@", "at"))
        after = [w for w in lower[where + 1:] if w not in ("]", ")", ">", "}")]
        before = [w for w in lower[:where] if w not in ("[", "(", "<", "{")]
        tail = lower[-1]
        out.append(f"address{bool(before)}{len(after) >= 3 and after[0].isalnum()}{tail.isalpha() and 2 <= len(tail) <= 6}")
        if any(w in ("dot", "at") for w in lower):
            out.append(f"spelled{'at' in lower}{'dot' in lower}")
    left = island.atoms[i - 1] if i else None
    right = island.atoms[j] if j < len(island.atoms) else None
    out.append(f"left{left[2] if left and left[1] == atoms[0][0] else ' '}")
    out.append(f"right{right[2] if right and right[0] == atoms[-1][1] else ' '}")
    for a, b, _ in island.atoms[max(0, i - CUED):i]:
        cue = _CUE.get(text[a:b].lower())
        if cue:
            out.append(f"cue {cue}")
    return out


# ---- the field ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    index: dict[str, int]
    weights: np.ndarray  # features x kinds

    def scores(self, named: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(named), len(KINDS)))
        for k, names in enumerate(named):
            known = [self.index[n] for n in names if n in self.index]
            out[k] = self.weights[known].sum(axis=0)
        return out


def best_segments(size: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The parse of ``size`` atoms with the highest sum of scores; atoms outside entities score 0. (first, end, kind) in order."""
    ending: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (_, j) in enumerate(segments):
        ending[j].append(k)
    kind = scores.argmax(axis=1) if len(segments) else []
    best, back = [0.0] * (size + 1), [-1] * (size + 1)
    for j in range(1, size + 1):
        best[j] = best[j - 1]
        for k in ending[j]:
            s = best[segments[k][0]] + scores[k, kind[k]]
            if s > best[j]:
                best[j], back[j] = s, k
    out, j = [], size
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append((*segments[back[j]], int(kind[back[j]])))
            j = segments[back[j]][0]
    return out[::-1]


def marginals(size: int, segments: list[tuple[int, int]], weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of every segment, and the logarithm of the sum over all parses. ``weight`` is the log of a segment's weight over all kinds."""
    forward, backward = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    forward[0] = backward[size] = 0.0
    starting: list[list[int]] = [[] for _ in range(size + 1)]
    ending: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (i, j) in enumerate(segments):
        starting[i].append(k)
        ending[j].append(k)
    for j in range(1, size + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[segments[k][0]] + weight[k] for k in ending[j]]])
    for i in range(size - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[segments[k][1]] + weight[k] for k in starting[i]]])
    total = forward[size]
    starts, ends = np.array([s[0] for s in segments], int), np.array([s[1] for s in segments], int)
    return np.exp(forward[starts] + weight + backward[ends] - total), total


def learn_field(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 30, step: float = 0.3, penalty: float = 0.02) -> Field | None:
    """Maximum penalised likelihood of labelled snippets (text, spans) by adaptive gradient steps."""
    parsed, index = [], {}
    for text, spans in examples:
        for island in islands(text, []):
            segments = list(candidates(text, island))
            if not segments:
                continue
            rows = [[index.setdefault(n, len(index)) for n in features(text, island, s)] for s in segments]
            wanted = {(a, b): k for a, b, k in spans}
            gold = [wanted.get((island.atoms[i][0], island.atoms[j - 1][1]), -1) for i, j in segments]
            parsed.append((len(island.atoms), segments, rows, np.array(gold)))
    if not any((gold >= 0).any() for *_, gold in parsed):
        return None
    flat = np.concatenate([np.array(r) for _, _, rows, _ in parsed for r in rows])
    owner = np.repeat(np.arange(sum(len(p[2]) for p in parsed)), [len(r) for p in parsed for r in p[2]])
    gold = np.concatenate([g for *_, g in parsed])
    target = np.zeros((len(gold), len(KINDS)))
    target[gold >= 0, gold[gold >= 0]] = 1.0
    cuts = np.cumsum([0] + [len(p[2]) for p in parsed])
    weights, scale = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-6)
    for _ in range(rounds):
        scores = np.zeros((len(gold), len(KINDS)))
        for k in range(len(KINDS)):
            scores[:, k] = np.bincount(owner, weights=weights[flat, k], minlength=len(gold))
        weight = np.logaddexp.reduce(scores, axis=1)
        chance = np.concatenate([marginals(p[0], p[1], weight[a:b])[0] for p, a, b in zip(parsed, cuts[:-1], cuts[1:])])
        pull = target - chance[:, None] * np.exp(scores - weight[:, None])
        slope = np.zeros_like(weights)
        for k in range(len(KINDS)):
            slope[:, k] = np.bincount(flat, weights=pull[owner, k], minlength=len(index))
        slope -= penalty * weights
        scale += slope ** 2
        weights += step * slope / np.sqrt(scale)
    return Field(index, weights)


def spellings(text: str, span: tuple[int, int, int]) -> list[tuple[str, int]]:
    """Other spellings of a span that the patterns do not know."""
    s, kind = text[span[0]:span[1]], span[2]
    if kind == 0:
        name, _, domain = s.partition("@")
        spoken = name.replace(".", " dot ") + " at " + domain.replace(".", " dot ")
        return [(v, kind) for v in (f"{name} at {domain.replace('.', ' dot ')}", f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", spoken)]
    if kind == 1:
        return [(s.replace(".", "[.]"), kind), (s.replace(".", " . "), kind)]
    if kind == 2:
        number = digits_of(s)
        return [(".".join(number[i:i + 4] for i in range(0, len(number), 4)), kind), ("_".join(number[i:i + 4] for i in range(0, len(number), 4)), kind)]
    return [("00" + s[1:], kind), (s.replace("+", "+ "), kind)]


def examples_of(snippets: list[tuple[str, list[tuple[int, int, int]]]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    out = []
    for text, spans in snippets:
        out.append((text, spans))
        if len(spans) == 1:
            a, b, _ = spans[0]
            for other, kind in spellings(text, spans[0]):
                out.append((text[:a] + other + text[b:], [(a, a + len(other), kind)]))
    return out


def all_spans(text: str | None, field: Field | None) -> tuple[list, list]:
    """The patterns' spans, and those with what the field adds, both ordered."""
    if not text:
        return [], []
    base = pattern_spans(text)
    more = []
    if field is not None:
        for island in islands(text, base):
            segments, scores = worthwhile(text, island, field)
            if segments:
                more += [(island.atoms[i][0], island.atoms[j - 1][1], k) for i, j, k in best_segments(len(island.atoms), segments, scores)]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def worthwhile(text: str, island: Island, field: Field) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The segments that some kind scores above 0, and their scores: no other can be in the best parse. Features are dropped again every
    ``AT_ONCE`` segments, as an island may be as long as its text."""
    segments, kept, every = [], [], candidates(text, island)
    while some := list(islice(every, AT_ONCE)):
        scores = field.scores([features(text, island, s) for s in some]) - MARGIN
        good = np.flatnonzero(scores.max(axis=1) > 0)
        segments += [some[k] for k in good]
        kept.append(scores[good])
    return segments, np.concatenate(kept) if kept else np.zeros((0, len(KINDS)))


# ---- Spark -------------------------------------------------------------------------------------------------------

def snippets(df: DataFrame, text: str, key: str, max_docs: int, max_islands: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``max_islands`` snippets around signs of personal data, from at most ``max_docs`` documents (expected), with their spans."""
    grain = 1 << 30
    share = min(grain, max_docs * grain // max(1, df.count()))
    drawn = df.filter(F.pmod(F.xxhash64(F.lit(23), F.col(key)), F.lit(grain)) < share).select(F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                if not t:
                    continue
                spans = pattern_spans(t)
                pieces = [(max(0, a - 60), min(len(t), b + 60)) for a, b, _ in spans]
                for i in islands(t, spans):  # in pieces of bounded length, as an island may be as long as its text
                    parts = [i.atoms[k:k + PIECE] for k in range(0, len(i.atoms), PIECE)]
                    pieces += [(max(0, p[0][0] - 20, p[-1][1] - REACH), min(len(t), p[-1][1] + 20)) for p in parts]
                out += [t[a:b] for a, b in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["piece"])

    found = drawn.mapInArrow(lean(cut), "piece string").distinct().orderBy(F.xxhash64("piece"), "piece").limit(max_islands).collect()
    return [(r["piece"], pattern_spans(r["piece"])) for r in found]


def learn(df: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = 20_000, max_islands: int = 240) -> Field | None:
    return learn_field(examples_of(snippets(df, text, key, max_docs, max_islands)))


def _named(spans: list[tuple[int, int, int]]) -> list[str]:
    return [f"{KINDS[k]}:{a}:{b}" for a, b, k in spans]


def found(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: lists of kind:start:end in code points, end exclusive."""
    return _mapped(df, field, text, [T.StructField("base", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StringType()))], False)


def masked(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets; a null text stays null."""
    return _mapped(df, field, text, [], True)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, field: Field | None, text: str, added: list[T.StructField], masking: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(field)  # bounded by the sample
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    order = [f.name for f in kept] + names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(text).to_pylist()
                spans = [all_spans(t, shared.value) for t in texts]
                columns = {f.name: part.column(f.name) for f in kept}
                if masking:
                    columns[text] = pa.array([mask(t, s) for t, (_, s) in zip(texts, spans)], pa.string())
                else:
                    columns["base"] = pa.array([_named(b) for b, _ in spans], pa.list_(pa.string()))
                    columns["spans"] = pa.array([_named(s) for _, s in spans], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    return df.mapInArrow(lean(run), T.StructType([*kept, *added]))
