"""Operator 11: secret scans by rules and a character convolutional network over every candidate and its context.

One pass over the texts applies the base rules and cuts out the candidates: runs of eight and more value characters that hold
a digit, change from lower to upper case or have twenty characters, each with the characters around it. What the base rules
found labels the candidates that it overlaps; the distinct candidates of two folds of three train the network (embedded characters that know
whether they lie inside the candidate, one convolution, the largest and the mean of each filter, a logistic output),
once with and once without their context. They are dealt to shards; in each round every shard trains the network on all of its own, and the
shards' networks are averaged. The third fold, counted whole by output, calibrates it (Platt) and gives each shape of candidate the
threshold that still finds ``recall`` of the labelled secrets, one half at most. Every candidate of every document is scored over its whole
length; those at or over the threshold that no base span overlaps are added as kind ``model``. Base spans stay whatever the network says.

Defined cases: a null text is empty; without a document of each label in both folds the network adds nothing; rows that repeat are
each scanned; ties of start go by kind; a null doc_id is returned as null; candidates may be as long as a text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, words

#: Distinct labelled candidates of either label that one task trains on; more are more tasks, and none is left out.
SAMPLE = 3000
#: Times that the shards' networks are averaged; training steps in all are ``_STEPS`` at least.
ROUNDS, _STEPS = 4, 240
#: Calibration counts candidates by output in steps of this fraction, from -_FAR to _FAR.
_FINE, _FAR = 1000, 60
#: Parameters are averaged as multiples of this fraction, so that their sum has no order.
_GRID = 1 << 32
#: Share of the labelled secrets that a threshold must keep.
RECALL = 0.98
#: Characters of context on either side.
CONTEXT = 24
KINDS = ("assign", "access", "hex", "model")
SHAPES = ("digits", "hex", "upper", "mixed")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
NOTABLE = re.compile(r"[0-9]|[a-z][A-Z]|^.{20}", re.S)
#: Other characters, and the edge of a region.
_OTHER, _EDGE = 128, 258
_WIDTH, _EMBED, _FILTERS, _PIECE = 5, 8, 24, 1 << 16
#: Symbols of a region that training looks at; scoring looks at all.
_TRAINED = 1024

_SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,lead:int,region:string,secret:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    # a run's only match that can be long enough is its first, so the length may stand in the pattern
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    out, ends = [], []
    for start, _, end in base:  # the furthest end up to each base span
        ends.append(max(end, ends[-1]) if ends else end)
    starts = np.array([s for s, _, _ in base], np.int64)
    for m in RUN.finditer(text):
        if NOTABLE.search(m[0]):
            start, end = m.span()
            before = int(np.searchsorted(starts, end))
            lead = min(start, CONTEXT)
            out.append({"start": start, "end": end, "lead": lead, "region": text[start - lead : end + CONTEXT], "secret": before > 0 and ends[before - 1] > start})
    return out


def shape_of(value: str) -> int:
    if value.isdigit():
        return 0
    if not value.strip("0123456789abcdef"):
        return 1
    return 2 if value.isalnum() and value.upper() == value else 3


def symbols(region: str, lead: int, size: int) -> np.ndarray:
    """A number for each character; those inside the candidate are told from its context."""
    codes = np.frombuffer(region.encode("latin-1", "replace"), np.uint8).astype(np.int64)
    codes = np.minimum(codes, _OTHER)
    codes[lead : lead + size] += _OTHER + 1
    return codes


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    #: Of the calibration: probability = sigmoid(a * logit + b).
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5,) * len(SHAPES)

    @staticmethod
    def new(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.3, (_EDGE + 1, _EMBED)), rng.normal(0, 0.3, (_WIDTH, _EMBED, _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.2, 2 * _FILTERS), np.zeros(1))

    def pooled(self, regions: list[np.ndarray]) -> np.ndarray:
        """Largest and mean activation of each filter over every whole region. What a symbol adds to a filter at each place
        of the window is a table, so the convolution is look-ups; regions are taken in pieces of bounded size."""
        tables = [self.embed @ w for w in self.filters]
        most, total = np.zeros((len(regions), _FILTERS)), np.zeros((len(regions), _FILTERS))
        side = _WIDTH // 2
        pieces, held = [], 0

        def work():
            codes = np.concatenate([p for _, p in pieces])
            sizes = np.array([len(p) - 2 * side for _, p in pieces])
            begin = np.cumsum(sizes + 2 * side) - sizes - 2 * side
            at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            active = self.bias + sum(table[codes[at + k]] for k, table in enumerate(tables))
            np.maximum(active, 0, out=active)
            first, owner = np.cumsum(sizes) - sizes, [i for i, _ in pieces]
            np.maximum.at(most, owner, np.maximum.reduceat(active, first))
            np.add.at(total, owner, np.add.reduceat(active, first))

        for i, region in enumerate(regions):
            padded = np.concatenate([[_EDGE] * side, region, [_EDGE] * side])
            for at in range(0, len(region), _PIECE):
                pieces.append((i, padded[at : at + _PIECE + 2 * side]))
                held += len(pieces[-1][1])
                if held >= _PIECE:
                    work()
                    pieces, held = [], 0
        if pieces:
            work()
        return np.concatenate([most, total / np.array([max(1, len(r)) for r in regions]).reshape(-1, 1)], axis=1)

    def logits(self, regions: list[np.ndarray]) -> np.ndarray:
        # rounded, so that it does not depend on what else is in the batch
        return np.round(self.pooled(regions) @ self.out + self.shift, 9) if regions else np.zeros(0)

    def values(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def with_values(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([v.size for v in self.values()])
        return Network(*[part.reshape(v.shape) for part, v in zip(np.split(flat, ends[:-1]), self.values(), strict=True)])

    def chances(self, regions: list[np.ndarray]) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits(regions) + b, -60, 60)))

    def gradients(self, regions: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss by every parameter, in their order."""
        side = _WIDTH // 2
        sizes = np.array([len(r) for r in regions])
        owner = np.repeat(np.arange(len(regions)), sizes)
        padded = np.concatenate([np.concatenate([[_EDGE] * side, r, [_EDGE] * side]) for r in regions])
        at = np.repeat(2 * side * np.arange(len(regions)), sizes) + np.arange(sizes.sum())
        window = padded[at[:, None] + np.arange(_WIDTH)]
        x = self.embed[window].reshape(len(at), -1)
        w = self.filters.reshape(-1, _FILTERS)
        raw = x @ w + self.bias
        active = np.maximum(raw, 0)
        first = np.cumsum(sizes) - sizes
        most, mean = np.maximum.reduceat(active, first), np.add.reduceat(active, first) / sizes[:, None]
        pooled = np.concatenate([most, mean], axis=1)
        error = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -60, 60))) - labels) * weights
        back = error[:, None] * self.out
        d = (back[:, _FILTERS:] / sizes[:, None])[owner]
        # the largest value's gradient goes to the first place that has it
        top = active == most[owner]
        place = np.where(top, np.arange(len(at))[:, None], len(at))
        best = np.minimum.reduceat(place, first)
        np.add.at(d, (best, np.arange(_FILTERS)), back[:, :_FILTERS])
        d *= raw > 0
        of_symbols = (d @ w.T).reshape(-1, _EMBED)
        d_embed = np.stack([np.bincount(window.reshape(-1), of_symbols[:, i], _EDGE + 1) for i in range(_EMBED)], axis=1)
        return [d_embed, (x.T @ d).reshape(self.filters.shape), d.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]


def train(net: Network, regions: list[np.ndarray], labels: np.ndarray, least: int, batch: int = 128, rate: float = 0.01, seed: int = 12) -> None:
    """Fits the network by Adam on batches that hold as many secrets as others; every region is used, once or more."""
    rng, half = np.random.default_rng(seed), batch // 2
    regions = [r[:_TRAINED] for r in regions]
    of = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    steps = max(least, *[-(-len(x) // half) for x in of])
    order = [np.concatenate([rng.permutation(x) for _ in range(-(-steps * half // len(x)))]) for x in of]
    values = net.values()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        some = np.concatenate([x[(step - 1) * half : step * half] for x in order])
        for v, g, m, s in zip(values, net.gradients([regions[i] for i in some], labels[some], np.full(len(some), 1 / len(some))), first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def calibrated(net: Network, logit: np.ndarray, counts: np.ndarray, labels: np.ndarray, shapes: np.ndarray, recall: float) -> Network:
    """Platt's line through the logits, by Newton's steps, and the thresholds; a row stands for ``counts`` candidates."""
    line = np.zeros(2)
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    n1, n = counts[labels == 1].sum(), counts.sum()
    wanted = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -60, 60)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (counts * (p - wanted)))
        line -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    net.calibration = (float(line[0]), float(line[1]))
    chance = 1 / (1 + np.exp(-np.clip(x @ line, -60, 60)))

    def keeps(which: np.ndarray) -> float:
        own = np.flatnonzero(which & (labels == 1))
        own = own[np.argsort(chance[own], kind="stable")]
        upto = np.cumsum(counts[own])
        return float(min(0.5, chance[own[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]])) if len(own) else 1.1

    overall = keeps(np.ones(len(labels), bool))
    # a shape of which no secret is known has the threshold of all
    net.thresholds = tuple(min(t, overall) if (t := keeps(shapes == s)) <= 1 else overall for s in range(len(SHAPES)))
    return net


def scan(docs: DataFrame) -> DataFrame:
    """What the rules find in each document, and its candidates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_assign", "n_access", "n_hex")], ("base_sha256", pa.string()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
            ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lead", pa.int32()), ("region", pa.string()), ("secret", pa.bool_())]))),
        ])
        for part in words.slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append({
                    "doc_id": doc_id, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "candidates": candidates(text, base),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(work, _SCANNED)


def labelled(scanned: DataFrame) -> DataFrame:
    """region, lead, size, secret, fold (0 and 1 train, 2 calibrates) of the distinct candidates."""
    c = scanned.select(F.explode("candidates").alias("c")).select("c.region", "c.lead", (F.col("c.end") - F.col("c.start")).alias("size"), "c.secret").distinct()
    return c.withColumn("fold", F.pmod(F.xxhash64("region", F.lit(22)), F.lit(3)).cast("int"))


def dealt(rows: DataFrame, n: dict[bool, int], shard: int) -> DataFrame:
    """Each label's candidates in parts of about ``shard``; every part of the more frequent label meets one of the other, and no part is left out."""
    parts = {secret: -(-many // shard) for secret, many in n.items()}
    own = F.when(F.col("secret"), parts[True]).otherwise(parts[False])
    first = F.pmod(F.xxhash64("region", "lead", "size", F.lit(21)), own)
    placed = rows.select("*", F.explode(F.sequence(first, F.lit(max(parts.values()) - 1).cast("long"), own.cast("long"))).alias("shard"))
    # training looks at no more of a region
    return placed.withColumn("region", F.substring("region", 1, _TRAINED))


def _numbers(region: list[str], lead: list[int], size: list[int]) -> list[np.ndarray]:
    return [symbols(r, at, n) for r, at, n in zip(region, lead, size, strict=True)]


def trained(shards: DataFrame) -> Network:
    """The network after all rounds. A task holds one shard; a row for each parameter comes back."""
    net = Network.new()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["secret", "region", "lead", "size"])
        labels = pdf["secret"].to_numpy(float)
        if 0 < labels.sum() < len(labels):
            own = Network(*[v.copy() for v in net.values()])
            whole = _numbers(pdf["region"], pdf["lead"], pdf["size"])
            # once more with a context of unknown characters
            train(own, whole + [np.where(s > _OTHER, s, _OTHER) for s in whole], np.tile(labels, 2), -(-_STEPS // ROUNDS), seed=12 + at)
            flat = np.concatenate([v.reshape(-1) for v in own.values()])
            return pd.DataFrame({"place": np.arange(len(flat)), "value": np.round(flat * _GRID).astype(np.int64)})
        return pd.DataFrame({"place": np.zeros(0, np.int64), "value": np.zeros(0, np.int64)})

    for at in range(ROUNDS):
        found = shards.groupBy("shard").applyInPandas(work, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).sort("place").collect()
        if found:
            net = net.with_values(np.array([r.value / r.n / _GRID for r in found]))
    return net


def counted(rows: DataFrame, net: Network) -> DataFrame:
    """output (in steps of 1 / _FINE), shape, secret and n of the candidates: a bounded table, however many there are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logit = np.clip(net.logits(_numbers(pdf["region"], pdf["lead"], pdf["size"])), -_FAR, _FAR)
            shapes = [shape_of(r[at : at + n]) for r, at, n in zip(pdf["region"], pdf["lead"], pdf["size"], strict=True)]
            yield pd.DataFrame({"output": np.floor(logit * _FINE).astype(np.int64), "shape": np.array(shapes, np.int64), "secret": pdf["secret"]})

    return rows.mapInPandas(work, "output long, shape long, secret boolean").groupBy("output", "shape", "secret").agg(F.count(F.lit(1)).alias("n"))


def fitted(scanned: DataFrame, shard: int, recall: float) -> Network | None:
    """The network trained and calibrated on all distinct labelled candidates; None where a fold lacks either label."""
    c = common.stored(labelled(scanned), "secrets-labelled")
    n = {(r.training, r.secret): r.n for r in c.groupBy((F.col("fold") < 2).alias("training"), "secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 4:
        return None
    net = trained(dealt(c.filter("fold < 2"), {secret: n[True, secret] for secret in (False, True)}, shard))
    bins = counted(c.filter("fold = 2"), net).sort("output", "shape", "secret").collect()
    column = lambda name: np.array([r[name] for r in bins], float)
    return calibrated(net, column("output") / _FINE, column("n"), column("secret"), column("shape"), recall)


def find(docs: DataFrame, shard: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model of every document."""
    scanned = common.stored(scan(docs), "secrets-scanned")
    net = fitted(scanned, shard, recall)
    shared = scanned.sparkSession.sparkContext.broadcast(net)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
        for batch in batches:
            base = [[(s["start"], s["kind"], s["end"]) for s in row] for row in batch.column("base").to_pylist()]
            added = [0] * len(base)
            if shared.value is not None:
                net = shared.value
                open_ones = [(i, c) for i, row in enumerate(batch.column("candidates").to_pylist()) for c in row if not c["secret"]]
                chance = net.chances([symbols(c["region"], c["lead"], c["end"] - c["start"]) for _, c in open_ones])
                for (i, c), p in zip(open_ones, chance.tolist(), strict=True):
                    if p >= net.thresholds[shape_of(c["region"][c["lead"] : c["lead"] + c["end"] - c["start"]])]:
                        base[i].append((c["start"], 3, c["end"]))
                        added[i] += 1
            spans = pa.array([joined(sorted(row)) for row in base], pa.string())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), spans, pa.array(added, pa.int64())], [*kept, "spans", "n_model"])

    return scanned.mapInArrow(add, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
