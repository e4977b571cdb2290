"""Secret scans: rules, and a character convolutional network for the candidates that no rule covers.

Rules find assignments, access keys and hex strings; their spans always stay. Every other run of
token characters that mixes kinds (``candidates``) is a candidate: the network reads all of its characters
and the ``CONTEXT`` bytes on both sides. Byte embeddings, marked as inside or outside the candidate, run
through filters of several widths; each filter hands on its largest response anywhere and its mean
response inside the candidate, a logistic unit joins them. It is trained in numpy on labelled
findings, its outputs are calibrated on findings that training did not see (a logistic fit), and the
threshold of each family (``FAMILIES``) is the highest one that keeps the wanted share of the true
findings (``RECALL``) there, but never below ``LEAST``.

Labelled findings (window, start, end, label) may come from anywhere; ``findings`` makes them from
the corpus: true ones are what the rules found, and keys of other make put in place of candidates or words; false
ones are look-alikes (identifiers, paths, versions, addresses, dates) in the same places. They are drawn from a
bounded sample of windows (``SAMPLE``) by a hash, and labels never depend on ids.

Defined results: a null text is empty and has no spans; repeated rows are scanned one by one; a null
id stays a row; texts are read whole, a very long candidate in pieces; without findings of both labels only the
rules apply; an empty table gives no rows; extra columns are ignored by ``scan`` and kept by ``redacted``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, drawn
from foliant.llm.words import batches, text_buffer

#: Fixed values of the rules: kind, pattern, least length and the group that has it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RULES = (("assign", ASSIGN, 12, 2), ("access", ACCESS, 18, 0), ("hex", HEX, 16, 0))
#: Texts in which a rule may match, told by Arrow's linear matcher before Python reads them.
HINTS = (r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{12}""", "AKIA[A-Z0-9]{14}", "[0-9a-f]{16}")
#: The kind of the spans that the network adds.
ADDED = "network"

CONTEXT = 24
LEAST_LENGTH = 12
SAMPLE = 2000
RECALL, LEAST = 0.98, 0.5
#: Families of candidates with a threshold of their own.
FAMILIES = ("letters and digits", "with marks", "no digits")
DIMS, FILTERS, WIDTHS = 6, 8, (2, 4)
#: Bytes of one candidate that are convolved at once.
PIECE = 1 << 16

_token = np.zeros(256, bool)
_token[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_digit, _upper, _small = (np.zeros(256, bool) for _ in range(3))
_digit[ord("0") : ord("9") + 1] = _upper[ord("A") : ord("Z") + 1] = _small[ord("a") : ord("z") + 1] = True
_mark = _token & ~_digit & ~_upper & ~_small


def _runs(hit: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``hit`` that no text boundary cuts."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[places] = True
    inside = np.concatenate([[False], hit, [False]])
    starts = inside[1:-1] & (~inside[:-2] | edge[:-1])
    ends = inside[1:-1] & (~inside[2:] | edge[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def candidates(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the candidates in joined texts, and their families.

    Runs of token characters without leading and trailing points and dashes, of ``LEAST_LENGTH`` bytes at least, that mix
    digits with letters, or hold no digit but change between capitals and small letters four times or more.
    """
    starts, ends = _runs(_token[raw], places)
    long = ends - starts >= LEAST_LENGTH
    starts, ends = starts[long], ends[long]
    trim = np.zeros(256, bool)
    trim[[*b".-_/"]] = True
    for _ in range(3):  # more of them make no key
        starts = starts + trim[raw[np.minimum(starts, len(raw) - 1)]]
        ends = ends - trim[raw[np.maximum(ends - 1, 0)]]
    long = ends - starts >= LEAST_LENGTH
    starts, ends = starts[long], ends[long]
    upper = _upper[raw]
    turns = np.zeros(len(raw), bool)
    turns[1:] = (upper[1:] & _small[raw[:-1]]) | (upper[:-1] & _small[raw[1:]])
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (_digit[raw], _digit[raw] | _mark[raw], _mark[raw], turns)]
    digits, others, marks, changes = (s[ends] - s[starts] for s in sums)
    letters = ends - starts - others
    keep = (digits > 0) & (letters > 0) | (digits == 0) & (changes >= 4)
    family = np.where(digits == 0, 2, np.where(marks > 0, 1, 0))
    return starts[keep], ends[keep], family[keep]


@dataclass
class Model:
    """A few thousand numbers, whatever the data."""

    table: np.ndarray  # (512, DIMS): bytes outside and inside the candidate
    taps: list[np.ndarray]  # by width: (width, DIMS, FILTERS)
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0  # calibration of the logit
    level: float = 0.0
    bars: tuple[float, ...] = (1.0,) * len(FAMILIES)


def _windows(raw: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Codes of each candidate and its surroundings within its text; 256 is added inside the candidate."""
    text = np.searchsorted(places, starts, "right") - 1
    low, high = np.maximum(starts - CONTEXT, places[text]), np.minimum(ends + CONTEXT, places[text + 1])
    out = []
    for a, s, e, b in zip(low.tolist(), starts.tolist(), ends.tolist(), high.tolist()):
        codes = raw[a:b].astype(np.int16)
        codes[s - a : e - a] += 256
        out.append(codes)
    return out


def _responses(model: Model, windows: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """(largest and mean responses of each window, what the gradient needs)."""
    size = FILTERS * len(WIDTHS)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
    codes = np.concatenate(windows)
    x = model.table[codes]
    inside = codes >= 256
    pooled = np.zeros((len(windows), 2 * size), np.float32)
    kept = []
    for k, width in enumerate(WIDTHS):
        n = len(codes) - width + 1
        z = sum(x[t : n + t] @ model.taps[k][t] for t in range(width)) + model.shift[k]
        for back in range(1, width):  # places whose filter would reach into the next window
            across = offsets[1:] - back
            z[across[(across >= 0) & (across < n)]] = -1e9
        z = np.maximum(z, 0)
        mine = slice(k * FILTERS, (k + 1) * FILTERS)
        mean = slice(size + k * FILTERS, size + (k + 1) * FILTERS)
        first = np.minimum(offsets[:-1], n - 1)
        pooled[:, mine] = np.maximum.reduceat(z, first, axis=0)
        weight = inside[:n].astype(np.float32)
        pooled[:, mean] = np.add.reduceat(z * weight[:, None], first, axis=0) / np.maximum(1, np.add.reduceat(weight, first))[:, None]
        kept.append((z, weight))
    return pooled, [codes, offsets, kept]


def _logits(model: Model, windows: list[np.ndarray]) -> np.ndarray:
    """Uncalibrated outputs; a long window is read in overlapping pieces, of which maxima and means are joined."""
    out, some, held = np.zeros(len(windows)), [], 0
    size, lap = FILTERS * len(WIDTHS), max(WIDTHS) - 1

    def flush() -> None:
        nonlocal some, held
        if some:
            pooled, _ = _responses(model, [windows[i] for i in some])
            out[some] = pooled @ model.out + model.bias
        some, held = [], 0

    for i, w in enumerate(windows):
        if len(w) > PIECE:
            pieces = [w[a : a + PIECE + lap] for a in range(0, len(w), PIECE)]
            pieces = [p for p in pieces if len(p) > lap]
            rows = np.concatenate([_responses(model, [p])[0] for p in pieces])
            parts = np.array([max(1, np.count_nonzero(p >= 256)) for p in pieces], np.float32)
            joined = np.concatenate([rows[:, :size].max(axis=0), (rows[:, size:] * parts[:, None]).sum(axis=0) / parts.sum()])
            out[i] = joined @ model.out + model.bias
            continue
        some.append(i)
        held += len(w)
        if held > PIECE:
            flush()
    flush()
    return out


def probabilities(model: Model, windows: list[np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _logits(model, windows) + model.level, -50, 50)))


def train(windows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, seed: int = 3) -> Model:
    """Stochastic gradient steps with a step size for each weight."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.3, (512, DIMS)).astype(np.float32),
        [rng.normal(0, 0.4, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, 2 * size).astype(np.float32),
        0.0,
    )
    kinds = np.concatenate([_digit, _digit]), np.concatenate([_upper, _upper]), np.concatenate([_small, _small]), np.concatenate([_mark, _mark])
    for d, kind in enumerate(kinds):  # bytes of a kind start alike
        model.table[kind, d] += 1
    params = [model.table, *model.taps, *model.shift, model.out]
    memory = [np.full_like(p, 1e-2) for p in params]
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    bias_memory = 1e-2
    for epoch in range(epochs):
        rate = 0.06 / (1 + 0.3 * epoch)
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            pooled, (codes, offsets, kept) = _responses(model, [windows[i] for i in some])
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
            error = ((p - labels[some]) * weight[labels[some]] / len(some)).astype(np.float32)
            down = error[:, None] * model.out
            owner = np.repeat(np.arange(len(some)), np.diff(offsets))
            flow = np.zeros((len(codes), DIMS), np.float32)
            taps, shift = [], []
            for k, (z, inside) in enumerate(kept):
                n = len(z)
                top, mean = down[:, k * FILTERS : (k + 1) * FILTERS], down[:, size + k * FILTERS : size + (k + 1) * FILTERS]
                best = pooled[:, k * FILTERS : (k + 1) * FILTERS][owner[:n]]
                counts = np.maximum(1, np.bincount(owner[:n], inside, len(some)))
                g = (z >= best) * top[owner[:n]] + (mean / counts[:, None].astype(np.float32))[owner[:n]] * inside[:, None]
                g *= z > 0
                x = model.table[codes]
                taps.append(np.stack([x[t : n + t].T @ g for t in range(len(model.taps[k]))]))
                shift.append(g.sum(axis=0))
                for t in range(len(model.taps[k])):
                    flow[t : n + t] += g @ model.taps[k][t].T
            table = np.zeros_like(model.table)
            np.add.at(table, codes, flow)
            for param, memo, grad in zip(params, memory, [table, *taps, *shift, pooled.T @ error], strict=True):
                memo += grad * grad
                param -= rate * grad / np.sqrt(memo)
            bias_memory += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / bias_memory**0.5
    return model


def calibrate(model: Model, windows: list[np.ndarray], labels: np.ndarray, families: np.ndarray, recall: float = RECALL) -> Model:
    """Fits slope and level on findings that training did not see, and a bar for each family that keeps ``recall`` of the true ones."""
    logit = _logits(model, windows)
    slope, level = 1.0, 0.0
    for _ in range(200):  # few numbers: plain gradient steps on a convex loss, with a weak pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * logit + level, -50, 50)))
        scale = max(1.0, float(np.abs(logit).mean()))
        slope -= 0.5 * (float(((p - labels) * logit).mean()) / scale**2 + 0.01 * (slope - 1))
        level -= 0.5 * float((p - labels).mean())
    model.slope, model.level = max(slope, 1e-3), level
    p = probabilities(model, windows)
    bars = []
    for family in range(len(FAMILIES)):
        true = np.sort(p[(families == family) & (labels == 1)])
        bars.append(max(LEAST, float(true[int((1 - recall) * len(true))])) if len(true) else LEAST)
    model.bars = tuple(bars)
    return model


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _secret(rng: random.Random) -> str:
    """A key of some common make."""
    mixed = _LETTERS + _LETTERS.upper() + _DIGITS
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    kind = rng.randrange(7)
    if kind == 0:
        return draw(mixed, rng.randrange(16, 48))
    if kind == 1:
        return draw(mixed + "+/", rng.choice([20, 28, 40, 64])) + rng.choice(["", "=", "=="])
    if kind == 2:
        return draw(mixed + "_-", rng.randrange(20, 60))
    if kind == 3:  # a prefix and a random body
        return draw(_LETTERS, rng.randrange(2, 5)) + rng.choice("_-") + rng.choice(["", "live_", "test_"]) + draw(mixed, rng.randrange(16, 40))
    if kind == 4:  # three parts joined by points
        return ".".join(draw(mixed + "_-", n) for n in (rng.randrange(16, 40), rng.randrange(20, 80), rng.randrange(20, 44)))
    if kind == 5:
        return draw("0123456789ABCDEF", rng.choice([16, 24, 32, 40]))
    return draw(_LETTERS.upper() + _DIGITS, rng.randrange(16, 40))


def _look_alike(rng: random.Random, words: list[str]) -> str:
    """Something long and mixed that is no key."""
    word = lambda: rng.choice(words)
    number = lambda n: str(rng.randrange(10**n))
    kind = rng.randrange(9)
    if kind == 0:
        return "_".join([word(), word(), word(), number(2)])
    if kind == 1:
        return word() + "".join(w.capitalize() for w in (word(), word(), word(), word())) + rng.choice(["", number(1)])
    if kind == 2:
        return "/".join(["src", word(), word(), word() + number(1) + rng.choice([".py", ".html", ".txt"])])
    if kind == 3:
        return f"{word()}-{number(1)}.{number(1)}.{number(2)}-{word()}"
    if kind == 4:
        return f"{word()}{number(2)}.{word()}.{rng.choice(['com', 'org', 'net'])}/{word()}"
    if kind == 5:
        return f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}"
    if kind == 6:
        return "-".join([word(), word(), number(3), word()])
    if kind == 7:
        return f"mail{number(1)}.{word()}.example.{rng.choice(['com', 'org'])}"
    return word() + word() + number(2)


@dataclass
class Finding:
    window: bytes
    start: int
    end: int
    label: int


def findings(windows: list[bytes], seed: int = 11) -> list[Finding]:
    """Labelled findings in the surroundings of ``windows``: for each, a key or what a rule found, and a look-alike, in its middle."""
    rng = random.Random(seed)
    plain = re.compile(rb"[A-Za-z]{3,10}")
    words = sorted({m.decode().lower() for w in windows for m in plain.findall(w)}) or ["text", "name", "value"]
    cues = ["", "", "", "key: ", "auth=", "Bearer ", "pwd ", '"', "credential "]
    plain_cues = ["", "", "", "", "file ", "at ", "see ", '"', "host: "]
    out = []
    for raw in windows:
        text = raw.decode(errors="ignore")
        found = next((m.group(group) for _, rule, least, group in RULES for m in rule.finditer(text) if len(m.group(group)) >= least), None)
        at = len(text) // 2
        left, right = text[:at].rpartition(" ")[0], text[at:].partition(" ")[2]
        for label in (1, 0):
            cue = rng.choice(cues if label else plain_cues)
            value = (found if found and rng.random() < 0.3 else _secret(rng)) if label else _look_alike(rng, words)
            before = f"{left[-60:]} {cue}".encode()
            own = value.encode()
            out.append(Finding(before + own + ('" ' if cue == '"' else rng.choice([" ", ". ", ", ", "\n"])).encode() + right[:60].encode(), len(before), len(before) + len(own), label))
    return out


def fit_findings(found: list[Finding], held: float = 0.3, seed: int = 5) -> Model | None:
    """Trains on most of ``found`` and calibrates on the rest; None without both labels."""
    if len({f.label for f in found}) < 2:
        return None
    raw = np.frombuffer(b"".join(f.window for f in found), np.uint8)
    places = np.concatenate([[0], np.cumsum([len(f.window) for f in found])])
    starts, ends = (np.array([getattr(f, x) for f in found]) + places[:-1] for x in ("start", "end"))
    windows = _windows(raw, places, starts, ends)
    labels = np.array([f.label for f in found])
    body = [np.frombuffer(f.window[f.start : f.end], np.uint8) for f in found]
    families = np.array([2 if not _digit[b].any() else 1 if _mark[b].any() else 0 for b in body])
    order = np.random.default_rng(seed).permutation(len(found))
    split = int(held * len(found))
    test, own = order[:split], order[split:]
    model = train([windows[i] for i in own], labels[own])
    return calibrate(model, [windows[i] for i in test], labels[test], families[test])


def sample_windows(docs: DataFrame, sample: int = SAMPLE, width: int = 160) -> list[bytes]:
    """At most ``sample`` pieces of distinct texts, drawn by a hash of the text; a piece lies round a rule's hint, else in the middle."""
    at = F.regexp_instr("text", F.lit(f"{HINTS[0]}|{HINTS[1]}"))
    at = F.greatest(F.lit(1), F.when(at > 0, at).otherwise(F.length("text") / 2).cast("int") - width // 2)
    rows = doc_rows(docs, "text").where(F.length("text") >= 40).select(F.xxhash64("text").alias("_key"), F.substr("text", at, F.lit(width)).alias("piece"))
    return [r["piece"].encode() for r in drawn(rows.groupBy("_key").agg(F.min("piece").alias("piece")), sample, "_key").collect()]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from findings made in at most ``sample`` windows of ``docs``."""
    return fit_findings(findings(sorted(sample_windows(docs, sample))))


def rule_spans(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text's rule matches, by start and then as ``RULES`` lists kinds; code points."""
    out: list[list] = [[] for _ in range(len(texts))]
    for (kind, rule, least, group), hint in zip(RULES, HINTS):
        for i in np.flatnonzero(pc.match_substring_regex(texts, hint).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            out[i] += [(m.start(), m.end(), kind) for m in rule.finditer(texts[i].as_py()) if len(m.group(group)) >= least]
    order = {kind: i for i, (kind, *_) in enumerate(RULES)}
    return [sorted(spans, key=lambda s: (s[0], order[s[2]])) for spans in out]


def network_spans(model: Model | None, texts: pa.Array, rules: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """(start, end, ADDED) of the candidates that overlap no rule match and reach their family's bar."""
    out: list[list] = [[] for _ in range(len(texts))]
    raw, places = text_buffer(texts)
    if model is None or not len(raw):
        return out
    starts, ends, family = candidates(raw, places)
    if not len(starts):
        return out
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    text = np.searchsorted(places, starts, "right") - 1
    first, last = points[starts] - points[places[text]], points[ends] - points[places[text]]
    free = np.ones(len(starts), bool)
    for i in np.unique(text).tolist():
        if spans := rules[i]:
            own = slice(*np.searchsorted(text, [i, i + 1]))
            low = np.array([s[0] for s in spans])
            reach = np.maximum.accumulate([s[1] for s in spans])
            before = np.searchsorted(low, last[own], "left")  # matches that begin before the candidate's end
            free[own] = (before == 0) | (reach[np.maximum(before - 1, 0)] <= first[own])
    starts, ends, family, text, first, last = (x[free] for x in (starts, ends, family, text, first, last))
    if not len(starts):
        return out
    sure = probabilities(model, _windows(raw, places, starts, ends)) >= np.array(model.bars)[family]
    for i, a, b in zip(text[sure].tolist(), first[sure].tolist(), last[sure].tolist()):
        out[i].append((a, b, ADDED))
    return out


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, rules, spans): of each row of ``docs``, the spans (start, end, kind) of the rules, and all with the network's; code points, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start:long,end:long,kind:string>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 1 << 20):
            texts = batch.column(1).cast(pa.large_string())
            rules = rule_spans(texts)
            added = network_spans(shared.value, texts, rules)
            every = [sorted(a + b, key=lambda s: s[0]) if b else a for a, b in zip(rules, added)]
            columns = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in spans] for spans in x], arrow) for x in (rules, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "rules", "spans"])

    return doc_rows(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, rules {kind}, spans {kind}")


def redacted(docs: DataFrame, model: Model | None, mark: str = "[secret]") -> DataFrame:
    """``docs`` (extra columns kept) with every span of ``text`` replaced by ``mark``; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 1 << 20):
            texts = batch.column(at).cast(pa.large_string())
            rules = rule_spans(texts)
            out = []
            for text, *spans in zip(texts.to_pylist(), rules, network_spans(shared.value, texts, rules)):
                if text is not None:
                    parts, done = [], 0
                    for start, end, _ in sorted(spans[0] + spans[1]):
                        if start >= done:
                            parts += [text[done:start], mark]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
