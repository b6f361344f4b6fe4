r"""Secret scanning: fixed patterns, and a character convolutional network over every candidate in its context.

Base findings follow three patterns (assign, access, hex). Candidates are all base findings, all runs of 16 or more of the
characters that secrets are made of with a letter or digit among them, and all runs of 8 or more that are set to a key word.
The network reads each candidate with the characters around it: an embedding of each character and a flag for the
candidate itself, a convolution, the maximum over all places, and a logistic output. It is trained on labelled findings:
the candidates of all documents, labelled by the base patterns, and made-up findings and harmless look-alikes from
templates. A candidate that no base pattern covers but that looks like a secret has no label and is left out. The labelled
windows are dealt to three parts, equal ones to the same: training, calibration (Platt scaling), and the threshold, which
is one half or, where that would miss more, the largest value that keeps the wanted recall. Candidates from the threshold
on that no base finding overlaps are added with kind `cnn`; base findings always stay, with their score.

Documents are searched once, and what is found is stored with its context. Training starts from the made-up windows alone
and goes on in rounds, each a Spark job that sums the gradient over all training windows; calibration and threshold come
from sums and counts over all windows of their parts. Only such sums and counts reach the driver. Equal windows are
gathered and weigh as often as they occur; where the documents have more windows of a class than are made up, each weighs
less, so that together they weigh as much as those.

Defined results: null texts count as empty and have no findings. Positions count code points, the end exclusive. Repeated
rows give repeated results. Texts and candidates of any length are read whole, long candidates in overlapping portions
whose maxima are taken together. An empty table gives an empty result (the network then learns from templates only). Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, stored, whole

#: Kinds of base findings, in the order that breaks ties of position.
KINDS = ("assign", "access", "hex")
#: Rounds of training over all labelled windows, and their step size.
ROUNDS, RATE = 30, 0.003
#: Made-up findings, and as many harmless look-alikes.
MADE_UP = 2500
#: Part of the labelled findings that the threshold must still report.
RECALL = 0.98
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 8
#: Characters that the network reads at once.
PORTION = 4096
#: Windows that are taken together, at most: for their outputs, and for a gradient.
TOGETHER, TRACED = 4096, 512
#: Bytes of windows after which a search gives out its rows, and rows that are scored together.
HELD, ROWS = 1 << 23, 1000

_assign = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_access = re.compile(r"AKIA[A-Z0-9]{12,}")
_hex = re.compile(r"[0-9a-f]{32,}")
_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_set_to = re.compile(r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|key|credentials?|auth|bearer)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})")
_alnum, _digit, _letter = re.compile(r"[A-Za-z0-9]"), re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs, and values set to a key word; of overlapping ones the first, of those the longer."""
    found = [m.span() for m in _run.finditer(text) if _alnum.search(m.group())] + [m.span(1) for m in _set_to.finditer(text)]
    out, end = [], 0
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


def clear_of(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[bool]:
    """For each span whether no finding overlaps it; both in order, spans apart from each other."""
    out, at, end = [], 0, 0
    for low, high in spans:
        while at < len(found) and found[at][0] < high:
            end = max(end, found[at][2])
            at += 1
        out.append(end <= low)
    return out


def secretlike(value: str) -> bool:
    """Letters and digits in no order that words have: at least 3.2 bits a character."""
    if not (_digit.search(value) and _letter.search(value)):
        return False
    share = np.unique(np.array([*value]), return_counts=True)[1] / len(value)
    return float(-(share * np.log2(share)).sum()) >= 3.2


#: Characters that the network tells apart: printable ASCII, and one number each for others, blanks and padding.
_ALPHABET = 98
_codes = np.full(0x110000, 96, dtype=np.int16)
_codes[32:127] = np.arange(1, 96)
_codes[[9, 10, 11, 12, 13]] = 97


def window(text: str, span: tuple[int, int]) -> tuple[np.ndarray, int, int]:
    """The characters' numbers of a candidate with its context, and the candidate's place among them."""
    low = max(0, span[0] - BEFORE)
    part = text[low : span[1] + AFTER]
    return _codes[np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)], span[0] - low, span[1] - low


def adam(weights: list[np.ndarray], rate: float) -> Callable[[list[np.ndarray]], None]:
    """A function that moves the weights, in place, against a gradient."""
    m, v, count = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0

    def step(gradient: list[np.ndarray]) -> None:
        nonlocal count
        count += 1
        for i, (w, g) in enumerate(zip(weights, gradient, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w -= rate * (m[i] / (1 - 0.9**count)) / (np.sqrt(v[i] / (1 - 0.999**count)) + 1e-8)

    return step


def platt_targets(harmless: float, findings: float) -> np.ndarray:
    """What the chances of harmless runs and of findings are fitted to."""
    return np.array([1 / (harmless + 2), (findings + 1) / (findings + 2)])


def platt(points: list[np.ndarray], z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each point (scale, shift): loss, two slopes, and the curvatures of scale, both and shift, summed over outputs."""
    rows = []
    for scale, shift in points:
        x = scale * z + shift
        chance = 1 / (1 + np.exp(-x.clip(-30, 30)))
        g, s = (chance - target) * weight, chance * (1 - chance) * weight
        rows.append([((np.logaddexp(0, x) - target * x) * weight).sum(), (g * z).sum(), g.sum(), (s * z * z).sum(), (s * z).sum(), s.sum()])
    return np.array(rows)


def newton(sums: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[float, float]:
    """Scale and shift of least loss and ridge, by steps that are halved until they help; `sums` gives what `platt` does."""

    def ridged(points: list[np.ndarray]) -> np.ndarray:
        return sums(points) + np.array([[0.5 * ((a - 1) ** 2 + b**2), a - 1, b, 1, 0, 1] for a, b in points])

    p = np.array([1.0, 0.0])
    [here] = ridged([p])
    for _ in range(50):
        step = np.linalg.solve(here[[3, 4, 4, 5]].reshape(2, 2), here[1:3])
        if np.abs(step).max() <= 1e-9:
            break
        tries = [p - step / 2**k for k in range(12)]
        there = ridged(tries)
        better = np.flatnonzero(there[:, 0] <= here[0])
        if not len(better):
            break
        p, here = tries[better[0]], there[better[0]]
    return float(p[0]), float(p[1])


@dataclass
class CharCNN:
    """embed (alphabet, e), kernel (width * (e + 1), filters), bias, out, out_bias; then calibration and threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    WIDTH = 5

    @classmethod
    def fresh(cls, seed: int = 7, size: int = 8, filters: int = 32) -> CharCNN:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (_ALPHABET, size)), r.normal(0, (2 / (cls.WIDTH * (size + 1))) ** 0.5, (cls.WIDTH * (size + 1), filters)), np.zeros(filters), r.normal(0, 0.2, filters), np.zeros(1))

    def padded(self, windows: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        most = max(max(len(c) for c, _, _ in windows), self.WIDTH)
        codes, inside = np.zeros((len(windows), most), dtype=np.int64), np.zeros((len(windows), most))
        for i, (c, low, high) in enumerate(windows):
            codes[i, : len(c)] = c
            inside[i, max(0, low) : max(0, high)] = 1  # of a portion, either may be before it
        return codes, inside

    def forward(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window and filter the highest value, and its place."""
        x = np.concatenate([self.embed[codes] * (codes > 0)[..., None].astype(np.float64), inside[..., None]], axis=2)
        n, length, size = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.WIDTH + 1, self.WIDTH * size)
        h = view @ self.kernel + self.bias
        # what a window gives must not depend on how far those beside it have it padded
        h[np.arange(h.shape[1]) > np.maximum((codes > 0).sum(axis=1) - self.WIDTH, 0)[:, None]] = -np.inf
        at = h.argmax(axis=1)
        return np.take_along_axis(h, at[:, None, :], axis=1)[:, 0, :], at

    def peaks(self, windows: list, traced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest value of each filter in each window and, if traced, the characters and flags that give it; windows of like lengths go together, long ones in portions."""
        peak = np.full((len(windows), len(self.out)), -np.inf)
        codes = np.zeros((*peak.shape, self.WIDTH) if traced else (0, 0, 0), dtype=np.int64)
        inside = np.zeros(codes.shape)
        parts = [(k, i, (c[k : k + PORTION + self.WIDTH - 1], low - k, high - k)) for i, (c, low, high) in enumerate(windows) for k in range(0, max(1, len(c) - self.WIDTH + 1), PORTION)]
        parts.sort(key=lambda p: (p[0], len(p[2][0])))
        start = 0
        while start < len(parts):
            stop = start + 1  # a window's portions come in different batches
            while stop < len(parts) and parts[stop][0] == parts[start][0] and (stop - start + 1) * len(parts[stop][2][0]) <= 4 * PORTION:
                stop += 1
            of = np.array([i for _, i, _ in parts[start:stop]])
            c, f = self.padded([w for _, _, w in parts[start:stop]])
            value, at = self.forward(c, f)
            if traced:
                where, rows, better = at[:, :, None] + np.arange(self.WIDTH), np.arange(len(of))[:, None, None], (value > peak[of])[:, :, None]
                codes[of], inside[of] = np.where(better, c[rows, where], codes[of]), np.where(better, f[rows, where], inside[of])
            peak[of] = np.maximum(peak[of], value)
            start = stop
        return peak, codes, inside

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.out_bias]

    def gradient(self, windows: list, labels: np.ndarray, weight: np.ndarray, smooth: float = 0.05) -> list[np.ndarray]:
        """Of the weighted loss, summed over windows; `smooth` keeps outputs from growing without end where the classes are apart."""
        out = [np.zeros_like(w) for w in self.weights()]
        for k in range(0, len(windows), TRACED):
            peak, codes, inside = self.peaks(windows[k : k + TRACED], traced=True)
            pooled = np.maximum(peak, 0)
            z = pooled @ self.out + self.out_bias[0]
            d = (1 / (1 + np.exp(-z.clip(-30, 30))) - np.where(labels[k : k + TRACED] == 1, 1 - smooth, smooth)) * weight[k : k + TRACED]
            d_peak = np.outer(d, self.out) * (peak > 0)
            taken = np.concatenate([self.embed[codes] * (codes > 0)[..., None], inside[..., None]], axis=3).reshape(*peak.shape, -1)  # (n, filters, width * size)
            back = (d_peak[:, :, None] * self.kernel.T[None]).reshape(*peak.shape, self.WIDTH, -1)[..., :-1]
            g_embed = np.stack([np.bincount(codes.ravel(), back[..., j].ravel(), _ALPHABET) for j in range(self.embed.shape[1])], axis=1)
            g_embed[0] = 0
            for total, g in zip(out, [g_embed, np.einsum("nfk,nf->kf", taken, d_peak), d_peak.sum(0), pooled.T @ d, np.array([d.sum()])], strict=True):
                total += g
        return out

    def train(self, windows: list, labels: np.ndarray, steps: int = 700, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        step = adam(self.weights(), rate)
        pools = [np.flatnonzero(labels == c) for c in (0, 1)]
        for _ in range(steps):
            pick = np.concatenate([r.choice(p, batch // 2) for p in pools])  # both classes alike
            step(self.gradient([windows[i] for i in pick], labels[pick], np.full(len(pick), 1 / len(pick))))

    def raw(self, windows: list) -> np.ndarray:
        """Outputs before calibration."""
        return np.concatenate([np.zeros(0), *[np.maximum(self.peaks(windows[k : k + TOGETHER])[0], 0) @ self.out + self.out_bias[0] for k in range(0, len(windows), TOGETHER)]])

    def calibrate(self, windows: list, labels: np.ndarray) -> None:
        """Platt scaling: the scale and shift of least loss and ridge."""
        z, weight = self.raw(windows), np.ones(len(labels))
        target = platt_targets(len(labels) - labels.sum(), labels.sum())
        self.scale, self.shift = newton(lambda points: platt(points, z, target[labels], weight))

    def set_threshold(self, findings: list, recall: float) -> None:
        """One half, or what keeps the recall of these findings where that is less."""
        chance = np.sort(self.chance(findings))
        self.threshold = min(0.5, float(chance[int(np.floor((1 - recall) * len(chance)))])) if len(chance) else 0.5

    def chance(self, windows: list) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(windows) + self.shift).clip(-30, 30)))


def dealt(count: int) -> np.ndarray:
    """Part of each of so many windows: 0 to 2 are for training, 3 for calibration, 4 for the threshold."""
    return np.random.default_rng(17).permutation(count) % 5


def fit(windows: list, labels: np.ndarray, recall: float = RECALL) -> CharCNN:
    """A network trained on three fifths of the labelled windows, calibrated on one, with its threshold set on the last."""
    part = dealt(len(labels))
    of = lambda chosen: [windows[i] for i in np.flatnonzero(chosen)]
    net = CharCNN.fresh()
    net.train(of(part < 3), labels[part < 3])
    net.calibrate(of(part == 3), labels[part == 3])
    net.set_threshold(of((part == 4) & (labels == 1)), recall)
    return net


#: Public forms of keys, as letters before random characters.
PREFIXES = ("ghp_", "glpat-", "xoxb-", "sk-", "sk_live_", "npm_", "eyJ")


def made_up(count: int = MADE_UP, seed: int = 3, without: tuple[str, ...] = ()) -> tuple[list, list[int]]:
    """Windows and labels of made-up findings, but of kinds in `without` (access, hex), and of harmless runs of the same characters."""
    r = np.random.default_rng(seed)
    pick = lambda alphabet, low, high: "".join(r.choice(list(alphabet), int(r.integers(low, high))))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    word = lambda: pick(lower, 3, 9)
    some = lambda values: values[int(r.integers(len(values)))]
    syllable = lambda: some(["", "b", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "v", "w", "sch", "th", "qu", "st"]) + some(["a", "e", "i", "o", "u", "ei", "ou", "ea"]) + some(["", "", "n", "r", "s", "t", "l", "ng", "ch", "nd"])
    spoken = lambda: "".join([syllable() for _ in range(int(r.integers(6, 11)))])
    secret = {
        "mixed": lambda: pick(lower + upper + digits + "+/", 32, 48), "hex": lambda: pick("0123456789abcdef", 32, 65), "access": lambda: "AKIA" + pick(upper + digits, 12, 17),
        "upper": lambda: pick(upper + digits, 16, 41), "prefixed": lambda: PREFIXES[int(r.integers(len(PREFIXES)))] + pick(lower + upper + digits, 20, 41), "padded": lambda: pick(lower + upper + digits, 20, 41) + "==",
        "lower": lambda: pick(lower + digits, 24, 41), "letters": lambda: pick(lower + upper, 24, 41), "short": lambda: pick(lower + upper + digits, 10, 17),
    }
    secret = [f for kind, f in secret.items() if kind not in without]
    named = ["{0} token = \"{1}\" {2}", "{0} secret: {1} {2}", "{0} password={1} {2}", "{0} api_key: '{1}', {2}", "{0} Authorization: Bearer {1} {2}", "{0} key: {1} {2}", "{0} credential={1}; {2}"]
    bare = ["{0} {1} {2}", "{0} {1}, {2}", "{0} ({1}) {2}", "{0} '{1}' {2}", "{0}: {1} {2}"]
    harmless = [
        lambda: f"mail{pick(digits, 1, 3)}/{word()}/{word()}", lambda: f"{word()}-{word()}-{word()}-{pick(digits, 1, 5)}", lambda: f"{pick('12', 1, 2)}0{pick(digits, 2, 3)}-0{pick('123456789', 1, 2)}-{pick('12', 1, 2)}{pick(digits, 1, 2)}T{pick(digits, 6, 7)}",
        lambda: f"{word()}_{word()}_{word()}_{pick(digits, 1, 3)}", lambda: f"{word()}{word()}{word()}{pick(digits, 1, 5)}", lambda: f"{word()}/{word()}/{word()}/{pick(digits, 1, 6)}", lambda: f"{word().title()}{word().title()}{word().title()}{pick(digits, 1, 2)}", lambda: pick("=-_", 16, 30) + pick(digits, 1, 3) + word(),
        lambda: word() + word() + word(), lambda: pick(digits, 16, 21), lambda: "-".join([pick(digits, 3, 5) for _ in range(4)]), lambda: word() + "-" + word() + "-" + word(),
        spoken, lambda: spoken().upper(), lambda: spoken().upper(), lambda: spoken().title(),
    ]
    plain = ["{0} https://{1} {2}", "{0} see {1}, {2}", "{0} file: {1} {2}", "{0} id={1} {2}", "{0} key: {1} {2}", "{0}!! {1}!! {2}", *bare]
    windows, labels = [], []
    for label, values in ((1, secret), (0, harmless)):
        for _ in range(count):
            value = values[int(r.integers(len(values)))]()
            # what is long enough to be a candidate by itself stands without a key word as often as with one
            shapes = plain if not label else named if len(value) < 16 or r.random() < 0.5 else bare
            text = shapes[int(r.integers(len(shapes)))].format(" ".join(word() for _ in range(3)), value, " ".join(word() for _ in range(2)))
            start = text.index(value)
            windows.append(window(text, (start, start + len(value))))
            labels.append(label)
    return windows, labels


#: What is asked of the network: kind number (cnn after the base kinds), place in the text, label (null: none), and the window.
_ASKED = "array<struct<kind: int, start: bigint, end: bigint, label: int, codes: binary, low: int, high: int>>"


def search(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, asked (base findings, and candidates that none overlaps, with their windows), in order."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("codes", pa.binary()), ("low", pa.int32()), ("high", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, start_row, held = [], 0, 0
            for at, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                found, spans = base_findings(text), candidates(text)
                asked = [(start, k, end, 1) for start, k, end in found]
                asked += [(low, len(KINDS), high, None if secretlike(text[low:high]) else 0) for (low, high), clear in zip(spans, clear_of(spans, found), strict=True) if clear]
                row = []
                for start, k, end, label in sorted(asked, key=lambda x: x[:3]):
                    codes, low, high = window(text, (start, end))
                    row.append({"kind": k, "start": start, "end": end, "label": label, "codes": codes.astype(np.uint8).tobytes(), "low": low, "high": high})
                    held += len(codes)
                out.append(row)
                if held > HELD or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start_row, len(out)), pa.array(out, kind)], ["id", "asked"])
                    out, start_row, held = [], at + 1, 0

    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, asked {_ASKED}")


def unpacked(codes: pa.Array, low: pa.Array, high: pa.Array) -> list[tuple[np.ndarray, int, int]]:
    return [(np.frombuffer(c, dtype=np.uint8), a, b) for c, a, b in zip(codes.to_pylist(), low.to_pylist(), high.to_pylist(), strict=True)]


def labelled(found: DataFrame) -> DataFrame:
    """Different windows with a label of what a search found, and made-up ones (made): codes, low, high, label, n (how often), part."""
    one = found.select(F.explode("asked").alias("a")).where("a.label is not null").select("a.codes", "a.low", "a.high", "a.label")
    real = one.groupBy("codes", "low", "high", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64("codes", "low", "high"), F.lit(5)).cast("int")).withColumn("made", F.lit(False))
    windows, labels = made_up()
    rows = [(c.astype(np.uint8).tobytes(), low, high, label, 1, int(part), True) for (c, low, high), label, part in zip(windows, labels, dealt(len(labels)), strict=True)]
    made = found.sparkSession.createDataFrame(rows, "codes binary, low int, high int, label int, n long, part int, made boolean")
    return real.sortWithinPartitions("codes", "low", "high", "label").unionByName(made)


def summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Numbers that f gives for batches of rows, summed over all: one row a partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = f(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = sorted(r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect())  # in an order that reruns keep
    return np.array(parts).sum(axis=0)


def weighed(rows: DataFrame, totals: dict[tuple[int, bool], int]) -> DataFrame:
    """Column weight: n, but less where there are more windows of a class than are made up, so that together they weigh as much."""
    share = F.lit(1.0)
    for label in (0, 1):
        made, real = totals[label, True], totals.get((label, False), 0)
        share = F.when((F.col("label") == label) & ~F.col("made"), min(1.0, made / max(1, real))).otherwise(share)
    return rows.withColumn("weight", F.col("n") * share)


def ranked(values: DataFrame, place: int) -> float:
    """The value x at a place, from 0, of the ascending order where each stands n times: the range that holds it is cut until one is left."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    while low < high:
        piece = F.floor((F.col("x") - low) / (high - low) * 1000)
        for r in values.where(F.col("x").between(low, high)).groupBy(piece.alias("piece")).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("piece").collect():  # at most 1,001 rows
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def learn_from(found: DataFrame, recall: float = RECALL) -> CharCNN:
    """Fit on all labelled windows of a search, and on made-up ones."""
    windows, labels = made_up()
    net = fit(windows, np.array(labels), recall)
    rows = stored(labelled(found), "secrets-windows")
    totals: dict[str, dict[tuple[int, bool], int]] = {"train": {}, "calibrate": {}, "threshold": {}}
    use = F.when(F.col("part") < 3, "train").when(F.col("part") == 3, "calibrate").otherwise("threshold")
    for r in rows.groupBy(use.alias("use"), "label", "made").agg(F.sum("n").alias("n")).collect():
        totals[r["use"]][r["label"], r["made"]] = r["n"]
    if not any(not made for of in totals.values() for _, made in of):
        return net

    def both(of: dict[tuple[int, bool], int]) -> np.ndarray:
        return np.array([of[c, True] + min(of[c, True], of.get((c, False), 0)) for c in (0, 1)])

    train, weight = weighed(rows.where("part < 3"), totals["train"]), both(totals["train"])

    def slope(batch: pa.RecordBatch) -> np.ndarray:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        w = batch.column("weight").to_numpy(zero_copy_only=False) / (2 * weight[label])  # both classes alike
        return np.concatenate([g.ravel() for g in net.gradient(unpacked(*[batch.column(c) for c in ("codes", "low", "high")]), label, w)])

    step, sizes = adam(net.weights(), RATE), np.cumsum([w.size for w in net.weights()])[:-1]
    for _ in range(ROUNDS):
        step([g.reshape(w.shape) for g, w in zip(np.split(summed(train, slope), sizes), net.weights(), strict=True)])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.raw(unpacked(*[batch.column(c) for c in ("codes", "low", "high")]))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("label"), batch.column("n"), batch.column("made"), pa.array(z, pa.float64())], ["part", "label", "n", "made", "z"])

    scored = stored(rows.where("part >= 3").mapInArrow(outputs, "part int, label int, n long, made boolean, z double"), "secrets-outputs")
    calibrate, target = weighed(scored.where("part = 3"), totals["calibrate"]), platt_targets(*both(totals["calibrate"]))

    def sums(points: list[np.ndarray]) -> np.ndarray:
        column = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)
        return summed(calibrate, lambda batch: platt(points, column(batch, "z"), target[column(batch, "label")], column(batch, "weight")).ravel()).reshape(-1, 6)

    net.scale, net.shift = newton(sums)
    count = sum(n for (label, _), n in totals["threshold"].items() if label)
    least = ranked(scored.where("part = 4 and label = 1").select((F.col("z") * net.scale + net.shift).alias("x"), "n"), int(np.floor((1 - recall) * count)))
    net.threshold = min(0.5, float(1 / (1 + np.exp(-np.clip(least, -30, 30)))))
    return net


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> CharCNN:
    """Fit on the labelled candidates of all documents and on made-up ones."""
    return learn_from(stored(search(docs, id_col, text_col), "secrets-found"), recall)


def score(found: DataFrame, net: CharCNN) -> DataFrame:
    """Of what a search found, one row per document: id, found (array of kind, start, end, score: the network's chance), in order."""
    names = np.array([*KINDS, "cnn"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            asked = batch.column(1)
            flat = asked.flatten()
            k = flat.field("kind").to_numpy(zero_copy_only=False)
            p = net.chance(unpacked(*[flat.field(c) for c in ("codes", "low", "high")]))
            keep = (k < len(KINDS)) | (p >= net.threshold)
            before = np.concatenate([[0], np.cumsum(keep)])
            ends = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))])
            kept = pa.StructArray.from_arrays([pa.array(names[k[keep]], pa.string()), flat.field("start").filter(pa.array(keep)), flat.field("end").filter(pa.array(keep)), pa.array(p[keep], pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), kept)], ["id", "found"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, found array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def scan(docs: DataFrame, net: CharCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, found (array of kind, start, end, score: the network's chance), in order."""
    return score(search(docs, id_col, text_col), net)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = stored(search(spread_table(spark, sf_dir, "documents")), "secrets-found")
    found = score(searched, learn_from(searched))
    spans = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "cnn")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 4)), ",").alias("scores"))
