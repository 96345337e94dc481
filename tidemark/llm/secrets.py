"""Secret scans: fixed patterns, and a small character network over every other token that might be one.

One pass over the texts keeps, per document, the findings of the fixed patterns and every further candidate
with its surrounding characters; texts are then done with. The network learns from all of those findings and
candidates but a fifth, which is held out by token: they are dealt to chunks by hash, tasks take steps over chunks,
and after each round the networks of its chunks are averaged. Scores are calibrated on everything held out, and the
threshold is the highest that still finds the asked share of held-out secrets. All candidates of all documents are
then scored.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linking import groups_of
from .scratch import dropped, written

LOG = logging.getLogger(__name__)
#: Fixed patterns: what each finds, and which part of a match must have how many characters.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "net")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
CONTEXT, WIDTH, FILTERS, EMBED = 24, 5, 16, 8
#: Tokens are scored in pieces of PIECE characters, each STRIDE on; a token counts as its highest piece.
PIECE, STRIDE = 96, 48
#: Windows of a chunk (on average) and of a step; parts of the chunks, of which each round takes one, and rounds of each network;
#: the recall that the threshold must keep.
CHUNK, BATCH, SLICES, MIN_RECALL, SEED = 4096, 64, 8, 0.95, 7
#: Kinds of windows: candidates, findings, made tokens. Made ones stand in for a quarter of the candidates, or MADE in all if that is more.
OTHER, KNOWN, MADE_UP = range(3)
MADE, MADE_SHARE, MAX_WEIGHT = 300, 0.25, 100.0
#: Scores go by steps of 1 / GRID up to LIMIT; LOST stands for secrets that are no candidates. Sums of networks are whole numbers of 1 / UNIT.
GRID, LIMIT, LOST, UNIT, LARGEST = 1024, 30, -(1 << 20), 1 << 34, 1 << 11
LETTERS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))

WINDOW = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("left", T.StringType()), T.StructField("token", T.StringType()), T.StructField("right", T.StringType())])
SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of 12 and more token characters that no fixed finding touches; telling words from secrets is the network's part."""
    out, at, upto = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            upto, at = max(upto, base[at][2]), at + 1
        if upto <= m.start():
            out.append((m.start(), m.end()))
    return out


def around(text: str, start: int, end: int) -> list[dict]:
    """The pieces of a token, each with its surrounding characters."""
    pieces = [(a, min(end, a + PIECE)) for a in range(start, max(start + 1, end - PIECE + STRIDE), STRIDE)]
    return [{"start": start, "end": end, "left": text[max(0, a - CONTEXT) : a], "token": text[a:b], "right": text[b : b + CONTEXT]} for a, b in pieces]


def found(documents: DataFrame) -> DataFrame:
    """doc_id, the fixed findings with counts and digest, windows of findings and of other candidates."""
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string(SCAN).fields, T.StructField("known", T.ArrayType(WINDOW)), T.StructField("other", T.ArrayType(WINDOW))])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                row = [*(sum(k == x for _, k, _ in base) for x in range(3)), hashlib.sha256(",".join(named).encode()).hexdigest(), named]
                row += [[x for a, _, b in base for x in around(text, a, b)], [x for a, b in candidates(text, base) for x in around(text, a, b)]]
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, types.field(i + 1).type) for i, c in enumerate(cols))], schema=types)

    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def encoded(windows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character ids of left, token and right with a flag for those of the token; 0 fills up."""
    length = max(WIDTH, max((len(a) + len(b) + len(c) for a, b, c in windows), default=WIDTH))
    ids, inside = np.zeros((len(windows), length), np.int64), np.zeros((len(windows), length), np.float32)
    for i, (a, b, c) in enumerate(windows):
        codes = np.frombuffer((a + b + c).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids[i, : len(codes)] = np.where(codes < 126, codes + 1, 127)
        inside[i, len(a) : len(a) + len(b)] = 1
    return ids, inside


@dataclass
class Network:
    """Embedding, one convolution, largest and mean response, logistic output; scale and shift calibrate it."""

    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Of held-out windows by their weights; precision counts a secret that no pattern knows as a wrong finding.
    recall: float | None = None
    precision: float | None = None

    @staticmethod
    def fresh(seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return Network({"e": f(128, EMBED) * 5, "k": f(WIDTH * (EMBED + 1), FILTERS), "b": np.zeros(FILTERS, np.float32), "o": f(2 * FILTERS), "c": np.zeros(1, np.float32)})

    def forward(self, ids: np.ndarray, inside: np.ndarray):
        x = np.concatenate([self.w["e"][ids] * (ids > 0)[..., None], inside[..., None]], axis=2)
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(WIDTH)], axis=2)
        h = np.maximum(cols @ self.w["k"] + self.w["b"], 0)
        live = (ids[:, WIDTH // 2 : WIDTH // 2 + n] > 0).astype(np.float32)[..., None]
        h = h * live
        top, count = h.argmax(axis=1), np.maximum(live.sum(axis=1), 1)
        feature = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.sum(axis=1) / count], axis=1)
        return feature @ self.w["o"] + self.w["c"][0], (cols, h, live, top, count, feature)

    def gradients(self, ids, inside, y, weight):
        z, (cols, h, live, top, count, feature) = self.forward(ids, inside)
        d = (weight * (1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT))) - y) / len(y)).astype(np.float32)
        g = {"o": feature.T @ d, "c": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.w["o"]
        dh = np.repeat((df[:, FILTERS:] / count)[:, None], h.shape[1], axis=1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + df[:, None, :FILTERS], 1)
        dh *= (h > 0) * live
        flat = dh.reshape(-1, FILTERS)
        g["k"], g["b"] = cols.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        dcols = (flat @ self.w["k"].T).reshape(*dh.shape[:2], WIDTH, EMBED + 1)[..., :EMBED]
        dx = np.zeros((*ids.shape, EMBED), np.float32)
        for k in range(WIDTH):
            dx[:, k : k + dh.shape[1]] += dcols[:, :, k]
        ge = np.stack([np.bincount(ids.ravel(), dx[..., j].ravel(), 128) for j in range(EMBED)], axis=1)
        ge[0] = 0
        return g | {"e": ge}

    def scores(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Scores in steps of 1 / GRID, as whole numbers; windows of about equal length go through together."""
        out = np.zeros(len(windows), np.int64)
        order = sorted(range(len(windows)), key=lambda i: sum(map(len, windows[i])))
        at = 0
        while at < len(order):
            width = sum(map(len, windows[order[at]])) + 32
            some = order[at : at + max(1, 20_000 // width)]
            some = [i for i in some if sum(map(len, windows[i])) <= 2 * width]
            out[some] = stepped(self.forward(*encoded([windows[i] for i in some]))[0])
            at += len(some)
        return out

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (scores / GRID) + self.shift, -LIMIT, LIMIT)))

    def probability(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        return self.calibrated(self.scores(windows))

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()]).astype(np.float64)

    @staticmethod
    def of(vector: np.ndarray) -> Network:
        net = Network.fresh()
        ends = np.cumsum([v.size for v in net.w.values()])
        net.w = {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(net.w.items(), np.split(vector, ends[:-1]), strict=True)}
        return net


def stepped(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z, -LIMIT, LIMIT) * GRID).astype(np.int64)


@dataclass
class Chunk:
    """Some windows, encoded: kinds, those held out, and those that are no candidates."""

    ids: np.ndarray
    inside: np.ndarray
    kind: np.ndarray
    held: np.ndarray
    lost: np.ndarray

    def some(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, inside = self.ids[at], self.inside[at]
        width = max(WIDTH, int((ids > 0).any(axis=0).sum()))
        return ids[:, :width].astype(np.int64), inside[:, :width].astype(np.float32)


def chunk_of(windows: list[tuple[str, str, str]], known: list[bool], share: float, seed: int) -> Chunk:
    """The windows and made tokens, ``share`` of them for each other candidate.

    Half of the secrets are shown without the words before them, and seeded random tokens stand in the
    surroundings of other candidates, so that the network learns what secrets look like and not only
    what announces them. What is held out goes by the token, so no token is on both sides.
    """
    r = np.random.default_rng((SEED, seed))
    pools = (LETTERS, LETTERS[:62], LETTERS[:52])  # with signs, without, and without digits
    out: list[tuple[tuple[str, str, str], int, bool]] = []
    for (a, b, c), secret in zip(windows, known, strict=True):
        bare = (re.sub(r"^.*[=:\s\"']", "", b) or b) if secret else b
        code = zlib.crc32(bare.encode("utf-8", "surrogatepass"))
        out.append(((a, bare if secret and code >> 8 & 1 else b, c), KNOWN if secret else OTHER, code % 5 == 0))
        for _ in range(0 if secret else int(share + r.random())):
            made = "".join(r.choice(pools[r.integers(3)], r.integers(12, 44)))
            out.append(((a, made, c), MADE_UP, zlib.crc32(made.encode()) % 5 == 0))
    out = [out[i] for i in r.permutation(len(out))]
    ids, inside = encoded([w for w, _, _ in out])
    lost = [kind != OTHER and not RUN.search(w[1]) for w, kind, _ in out]
    return Chunk(ids.astype(np.uint8), inside.astype(np.uint8), np.array([k for _, k, _ in out], np.uint8), np.array([h for _, _, h in out], bool), np.array(lost, bool))


def plain_windows() -> list[tuple[str, str, str]]:
    """Seeded words in place of candidates where a corpus has none."""
    r = np.random.default_rng(SEED)
    return [(" ", "".join(r.choice(LETTERS[26:52], r.integers(12, 20))), " ") for _ in range(200)]


def weights_of(counts: list[int]) -> np.ndarray:
    """Weight of a window of each kind: rare secrets come to weigh as much as other candidates, findings twice as much as made ones."""
    share = np.array([1.0, 2 / 3 if counts[KNOWN] else 0.0, 1 / 3 if counts[KNOWN] else 1.0])
    return np.clip(share * counts[OTHER] / np.maximum(counts, 1), 1.0, MAX_WEIGHT)


def adam(state: np.ndarray, chunk: Chunk, weight: np.ndarray, first: Network | None, seed: int) -> np.ndarray:
    """The state (weights, both moments, steps taken) after one pass over a chunk; what ``first`` takes for a secret among other candidates stays out."""
    at = np.flatnonzero(~chunk.held)
    if first is not None:
        z = np.concatenate([np.zeros(0), *(first.forward(*chunk.some(at[i : i + 2 * BATCH]))[0] for i in range(0, len(at), 2 * BATCH))])
        at = at[(chunk.kind[at] != OTHER) | (z < 0)]
    if not len(at):
        return state
    r = np.random.default_rng((SEED, seed))
    (vector, m, v), taken = state[:-1].reshape(3, -1).copy(), state[-1]
    for some in np.array_split(r.permutation(at), max(1, len(at) // BATCH)):
        kind = chunk.kind[some]
        g = Network.of(vector).gradients(*chunk.some(some), (kind != OTHER).astype(np.float32), weight[kind])
        flat = np.concatenate([g[k].ravel() for k in ("e", "k", "b", "o", "c")])
        taken += 1
        m += 0.1 * (flat - m)
        v += 0.01 * (flat**2 - v)
        vector -= 0.01 * (m / (1 - 0.9**taken)) / (np.sqrt(v / (1 - 0.99**taken)) + 1e-8)
    return np.concatenate([vector, m, v, [taken]])


def held_scores(net: Network, chunk: Chunk) -> Iterator[tuple[int, int, int]]:
    """(kind, score, how many) of what is held out."""
    at = np.flatnonzero(chunk.held)
    z = np.concatenate([np.zeros(0, np.int64), *(stepped(net.forward(*chunk.some(at[i : i + 2 * BATCH]))[0]) for i in range(0, len(at), 2 * BATCH))])
    z[chunk.lost[at]] = LOST
    for kind in range(3):
        for score, n in zip(*(x.tolist() for x in np.unique(z[chunk.kind[at] == kind], return_counts=True)), strict=True):
            yield kind, score, n


def whole(state: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(state, -LARGEST, LARGEST) * UNIT).astype(np.int64)


#: What each chunk of a slice (all for None) gives, and their sum: (chunk number, chunk) to an array, by slice.
Averaged = Callable[[int | None, Callable[[int, Chunk], np.ndarray]], tuple[np.ndarray, int]]


def learned(averaged: Averaged, held: Callable[[Network], np.ndarray], counts: list[int], slices: int, min_recall: float = MIN_RECALL) -> Network:
    """Two networks by rounds over slices of the chunks, each slice once where there are SLICES of them; the second is calibrated.

    Other candidates may be secrets that no pattern knows: those that a first network takes for one are left
    out of the second. The held-out fifth has no part in either.
    """
    weight, first, seed = weights_of(counts), None, 0
    for _ in range(2):
        start = Network.fresh().vector()
        state = np.concatenate([start, np.zeros(2 * len(start) + 1)])
        for at in range(SLICES):
            seed += 1
            total, n = averaged(at % slices, lambda i, chunk, state=state, first=first, seed=seed: whole(adam(state, chunk, weight, first, seed * (1 << 24) + i)))
            state = total / UNIT / n if n else state
        net = Network.of(state[: len(start)])
        first = first or net
    return thresholded(net, held(net), weight, min_recall)


def thresholded(net: Network, found: np.ndarray, weight: np.ndarray, min_recall: float) -> Network:
    """Calibrate on the (kind, score, how many) of everything held out and set the threshold; kinds have the weights of training."""
    kind, score, n = found.T
    y, w = (kind != OTHER).astype(np.float64), weight[kind] * n
    told = score != LOST
    z, scale, shift = score[told] / GRID, 1.0, 0.0
    if told.any():
        part = w[told] / w[told].sum()
        for _ in range(300):  # logistic calibration of held-out scores
            p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -LIMIT, LIMIT)))
            off = part * (p - y[told])
            scale, shift = scale - 0.1 * float((off * z).sum() / (1 + (part * z**2).sum())), shift - 0.5 * float(off.sum())
    net.scale, net.shift = scale, shift
    p = np.where(told, net.calibrated(score), 0.0)
    secret = np.flatnonzero(y > 0)
    if len(secret):
        order = secret[np.argsort(-p[secret], kind="stable")]
        reached = np.cumsum(w[order])
        net.threshold = float(p[order[np.searchsorted(reached, min_recall * reached[-1] * (1 - 1e-12))]])
        hit = p >= net.threshold
        net.recall, net.precision = float(w[hit & (y > 0)].sum() / w[y > 0].sum()), float(w[hit & (y > 0)].sum() / w[hit].sum())
        LOG.info("held-out recall %.3f, precision %.3f at threshold %.4f", net.recall, net.precision, net.threshold)
    return net


def trained(positive: list[tuple[str, str, str]], negative: list[tuple[str, str, str]], min_recall: float = MIN_RECALL) -> Network:
    """The network that ``learned`` gets from windows at hand, which are one chunk."""
    negative = negative or plain_windows()
    chunk = chunk_of(positive + negative, [True] * len(positive) + [False] * len(negative), made_share(len(negative)), 0)
    counts = np.bincount(chunk.kind, minlength=3).tolist()
    return learned(lambda _, f: (f(0, chunk), 1), lambda net: np.array(list(held_scores(net, chunk)), np.int64).reshape(-1, 3), counts, 1, min_recall)


def made_share(n_other: int) -> float:
    return max(MADE_SHARE, MADE / max(1, n_other))


PACKED = "slice int, chunk long, n_other long, n_known long, n_made long, width int, ids binary, inside binary, kind binary, held binary, lost binary"


def chunks(rows: DataFrame, n_chunks: int, n_other: int) -> DataFrame:
    """All windows of all documents in packed chunks, dealt by hash and each in one order, whatever the partitions were."""
    share = made_share(n_other)
    both = rows.select("doc_id", F.size("known").alias("n"), F.posexplode(F.concat("known", "other")).alias("at", "x"))
    each = both.select(F.xxhash64("doc_id", "x.start", "x.left", "x.token", "x.right").alias("h"), "x.left", "x.token", "x.right", (F.col("at") < F.col("n")).alias("known"))
    if not n_other:
        made = rows.sparkSession.createDataFrame(plain_windows(), "left string, token string, right string")
        each = each.union(made.select(F.xxhash64("left", "token", "right"), "left", "token", "right", F.lit(False)))
    each = each.withColumn("chunk", F.pmod("h", F.lit(n_chunks)))
    order = ["chunk", "h", "left", "token", "right", "known"]

    def pack(batches):
        for table, group in groups_of(batches, ["chunk"]):
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(group)], strict=True):
                some = table.slice(a, b - a)
                number = some.column("chunk")[0].as_py()
                x = chunk_of(list(zip(*(some.column(c).to_pylist() for c in ("left", "token", "right")), strict=True)), some.column("known").to_pylist(), share, number)
                n = np.bincount(x.kind, minlength=3).tolist()
                yield pa.RecordBatch.from_pylist([{"slice": number % SLICES, "chunk": number, "n_other": n[OTHER], "n_known": n[KNOWN], "n_made": n[MADE_UP], "width": x.ids.shape[1], **{c: getattr(x, c).tobytes() for c in ("ids", "inside", "kind", "held", "lost")}}], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(T._parse_datatype_string(PACKED))
    return each.repartition("chunk").sortWithinPartitions(*order).mapInArrow(pack, PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            x = {c: batch.column(c)[i] for c in ("chunk", "width", "ids", "inside", "kind", "held", "lost")}
            ids, inside, kind, held, lost = (np.frombuffer(x[c].as_buffer(), np.uint8) for c in ("ids", "inside", "kind", "held", "lost"))
            width = x["width"].as_py()
            yield x["chunk"].as_py(), Chunk(ids.reshape(-1, width), inside.reshape(-1, width), kind, held.astype(bool), lost.astype(bool))


def trained_on(rows: DataFrame) -> Network:
    """A network that learned from every window of every document but those held out; the driver gets sums alone."""
    n_known, n_other = rows.agg(*(F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in ("known", "other"))).first()
    n_chunks = -(-int((n_known + n_other * (1 + made_share(n_other))) or 1) // CHUNK)
    table = written(chunks(rows, n_chunks, n_other), "windows", ["slice"])
    counts = list(table.agg(*(F.sum(c) for c in ("n_other", "n_known", "n_made"))).first())

    def averaged(at, f):
        def run(batches):
            total, n = 0, 0
            for number, chunk in unpacked(batches):
                total, n = total + f(number, chunk), n + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.r_[total, n])], ["at", "value"])

        some = table.where(F.col("slice") == at).mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        value = some.sort_by("at").column("value").to_numpy()
        return (value[:-1], int(value[-1])) if len(value) else (value, 0)

    def held(net):
        def run(batches):
            for _, chunk in unpacked(batches):
                found = np.array(list(held_scores(net, chunk)), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["kind", "score", "n"])

        some = table.mapInArrow(run, "kind long, score long, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).toArrow()
        some = some.sort_by([("kind", "ascending"), ("score", "ascending")])  # at most a few times GRID * LIMIT rows
        return np.stack([some.column(c).to_numpy() for c in ("kind", "score", "n")], axis=1)

    net = learned(averaged, held, [int(n or 0) for n in counts], min(SLICES, n_chunks))
    dropped(table)
    return net


def scanned(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts and digest of the fixed findings, all spans, n_net, net_score and the network's figures.

    spans lists kind:start:end by start and then kind, those of the network as kind net. threshold, held_recall
    and held_precision are the same in all rows: what the network keeps, and what that finds of held-out
    windows. A null text is an empty one; texts and tokens of any length are scored whole, in time that follows
    their length; equal rows get equal results. Training, calibration and threshold use every finding and every other candidate. Without any
    finding the network learns from made tokens alone.
    """
    rows = written(found(documents), "secrets")
    net = trained_on(rows)
    held = rows.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, net_score double, threshold double, held_recall double, held_precision double").fields])

    def score(batches):
        net = held.value
        for batch in batches:
            base, other = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            flat = [(i, x) for i, xs in enumerate(other) for x in xs]
            p = net.probability([(x["left"], x["token"], x["right"]) for _, x in flat])
            best: list = [None] * len(base)
            added: list[list] = [[] for _ in base]
            for (i, x), q in zip(flat, p.tolist(), strict=True):
                best[i] = max(best[i] or 0.0, q)
                span = (x["start"], 3, x["end"])
                if q >= net.threshold and added[i][-1:] != [span]:  # pieces of a token follow each other
                    added[i].append(span)
            spans = []
            for named, more in zip(base, added, strict=True):
                split = [s.split(":") for s in named]
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted([(int(a), KINDS.index(k), int(b)) for k, a, b in split] + more)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(spans, pa.string()), pa.array([len(x) for x in added], pa.int64()), pa.array(best, pa.float64()), *(pa.array([x] * len(base), pa.float64()) for x in (net.threshold, net.recall, net.precision))], schema.names
            )

    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "other").mapInArrow(score, schema)
