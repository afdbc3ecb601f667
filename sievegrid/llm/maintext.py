"""Main text of HTML pages, by a recurrent labeller over the page's blocks.

A tolerant scanner cuts a page into leaf blocks: runs of text between block-level tags, each with the path of
open tags and their class, id and role words. A bidirectional LSTM in numpy reads the whole sequence of blocks, as
hashed path words, hashed text words and a few measures of a block, and says of each whether it is main text. So a
block without telling tags is judged by its neighbourhood too. Blocks that are main text are joined in page order.
Inline elements, buttons and formulas are part of their block's text, and ``xmp`` is a block of the text that it shows.

The weights are trained when first asked for, and kept in the shared folder for later sessions, on pages drawn from ``page_maker``, a seeded generator of
varied layouts whose labels are known; nothing is learnt from the pages that are read. Pages are independent rows:
there is no shuffle, and a batch is labelled in steps of whole columns of pages of like length.

Defined results: a null or empty html has an empty text; markup that never closes is read to its end; very long
pages are read whole, those of over ``STRETCH`` blocks in stretches that see ``CONTEXT`` more blocks on either side;
repeated rows come back as often as given; null ids and urls are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import inspect
import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.shared import exists, read_table, shared_folder

# HTML element names by how they take part in a page.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED_TAGS = frozenset("head svg object canvas select audio video".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_PART = re.compile("[a-z]+")
#: What ends a raw element; its content is not markup, whatever it looks like.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW_TAGS}

PATH_BITS, WORD_BITS, MEASURES = 9, 5, 7
PATHS = 1 << PATH_BITS
WIDTH = PATHS + (1 << WORD_BITS) + MEASURES
HIDDEN = 24
#: Blocks that are labelled in one sequence, and those that a stretch of a longer page sees besides on either side.
STRETCH, CONTEXT = 4096, 256
SEED = 31


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path words, text, share of link text) of each leaf block of a page, in order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links_at: list[int] = []  # where the stack holds anchors that lead somewhere
    linked = dropped = at_char = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            out.append((tuple(w for _, own in stack for w in own), words, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal dropped
        for name, _ in stack[to:]:
            dropped -= name in DROPPED_TAGS
        while links_at and links_at[-1] >= to:
            links_at.pop()
        del stack[to:]

    while token := _TOKEN.match(page, at_char):
        at_char = token.end()
        name = token[2]
        if name is None:
            if not dropped and token[0][:2] not in ("<!", "<?"):
                text.append(token[0])
                linked += len(token[0]) if links_at else 0
            continue
        name = name.lower()
        block = name in BLOCK_TAGS
        if block or name in DROPPED_TAGS:
            flush()
        if token[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None and (block or all(x not in BLOCK_TAGS for x, _ in stack[at + 1 :])):
                pop(at)
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
        if name in VOID_TAGS:
            continue
        if name in RAW_TAGS:
            end = _RAW_END[name].search(page, at_char)
            start, at_char = at_char, end.start() if end else len(page)
            if name == "xmp" and not dropped:  # shown as it stands
                flush()
                stack.append((name, (name,)))
                text.append(page[start:at_char].replace("&", "&amp;"))
                flush()
                stack.pop()
            continue
        if name == "body" or (dropped and name in ("article", "main", "nav", "header", "footer", "div", "p", "h1") and any(x == "head" for x, _ in stack)):
            at = next((i for i, (x, _) in enumerate(stack) if x == "head"), None)
            if at is not None:
                pop(at)
        if block:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if at is not None and all(x not in BLOCK_TAGS for x, _ in stack[at + 1 :]):
                pop(at)
        if name in CLOSES:
            same, within = (x.split() for x in CLOSES[name])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in same:
                    pop(i)
                    break
        words = [p for m in _ATTRIBUTE.finditer(token[3]) for p in _PART.findall((m[2] or m[3] or m[4] or "").lower())] if block else []
        link = name == "a" and _HREF.search(token[3]) is not None
        stack.append((name, (name, *(f".{w}" for w in words)) if block else ()))
        dropped += name in DROPPED_TAGS
        if link:
            links_at.append(len(stack) - 1)
    flush()
    return out


def _slots(words, bits: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.int64) & ((1 << bits) - 1)


def _measures(text: str, links: float) -> tuple[float, ...]:
    marks = sum(text.count(x) for x in ".,;:!?")
    few = text.count(" ") < 3
    return min(1.0, len(text) / 400), np.log1p(len(text)) / 8, links, min(1.0, 20 * marks / len(text)), float(text[-1] in ".!?:"), float(few), float(text[0] == "©")


class Features:
    """Input of blocks: the slots of their path words, which are kept by path, as a site's pages share few, and a dense rest."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def slots(self, path: tuple[str, ...]) -> np.ndarray:
        at = self.paths.get(path)
        if at is None:
            at = _slots({w.encode() for w in (*path, *(f"<{a}<{b}" for a, b in zip(path[-2:], path[-1:])))}, PATH_BITS)
            if len(self.paths) < 50_000:
                self.paths[path] = at
        return at

    def rest(self, page: list[tuple[tuple[str, ...], str, float]], start: int = 0, end: int | None = None) -> np.ndarray:
        """Hashed words and measures of the blocks of a stretch of a page."""
        part = page[start:end]
        rows = np.zeros((len(part), WIDTH - PATHS), dtype=np.float32)
        for row, (_, text, links) in zip(rows, part):
            words = text.encode().lower().split()
            row[:-MEASURES] = np.bincount(_slots(words, WORD_BITS), minlength=1 << WORD_BITS) / len(words)
            row[-MEASURES:] = _measures(text, links)
        return rows

    def __call__(self, page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        """Whole rows, for training."""
        rows = np.zeros((len(page), WIDTH), dtype=np.float32)
        for row, (path, _, _) in zip(rows, page):
            row[self.slots(path)] = 1.0
        rows[:, PATHS:] = self.rest(page)
        return rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from each end, and a logistic layer over both states of a block."""

    def __init__(self, rng: np.random.Generator):
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
            self.w[f"h{side}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.w["o"], self.w["d"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, pages, HIDDEN); a page's state stands still where ``mask`` is 0."""
        steps, pages = mask.shape
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        h, c = np.zeros((pages, HIDDEN), dtype=x.dtype), np.zeros((pages, HIDDEN), dtype=x.dtype)
        out = np.zeros((steps, pages, HIDDEN), dtype=x.dtype)
        recur = self.w[f"h{side}"].astype(x.dtype)
        for t in order:
            gates = x[t] + h @ recur
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, squashed, on))
            h, c = on * o * squashed + (1 - on) * h, on * new_c + (1 - on) * c
            out[t] = h
        return out

    def _said(self, inputs: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        return _sigmoid(np.concatenate([self._run(s, inputs[s], mask) for s in "fb"], axis=2) @ self.w["o"] + self.w["d"])

    def probabilities(self, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._said({s: rows @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb"}, mask)

    def label(self, parts: list[tuple[list, int, int]], featurise: Features) -> list[np.ndarray]:
        """Whether each block of (page, start, end) is main text; a path's share of the input is worked out once."""
        steps = max(end - start for _, start, end in parts)
        mask = np.zeros((steps, len(parts)), dtype=np.float32)
        inputs = {s: np.zeros((steps, len(parts), 4 * HIDDEN), dtype=np.float32) for s in "fb"}
        known: dict[tuple[str, ...], int] = {}
        for i, (page, start, end) in enumerate(parts):
            at = [known.setdefault(path, len(known)) for path, _, _ in page[start:end]]
            rest = featurise.rest(page, start, end)
            mask[: end - start, i] = 1
            for s in "fb":
                inputs[s][: end - start, i] = rest @ self.w[f"x{s}"][PATHS:].astype(np.float32) + self.w[f"c{s}"]
            parts[i] = (at, start, end)
        slots = [featurise.slots(path) for path in known]
        for s in "fb":
            share = np.array([self.w[f"x{s}"][at].sum(axis=0) for at in slots], dtype=np.float32)
            for i, (at, _, _) in enumerate(parts):
                inputs[s][: len(at), i] += share[at]
        said = self._said(inputs, mask) >= 0.5
        return [said[: len(at), i] for i, (at, _, _) in enumerate(parts)]

    def gradients(self, rows: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._run(s, rows @ self.w[f"x{s}"] + self.w[f"c{s}"], mask, kept[s]) for s in "fb"]
        both = np.concatenate(states, axis=2)
        error = (_sigmoid(both @ self.w["o"] + self.w["d"]) - labels) * mask / mask.sum()
        grad = {"o": np.einsum("tp,tph->h", error, both), "d": np.array([error.sum()])}
        for side, part in zip("fb", (slice(0, HIDDEN), slice(HIDDEN, None))):
            into = error[:, :, None] * self.w["o"][part]
            dh, dc = np.zeros_like(into[0]), np.zeros_like(into[0])
            dx = np.zeros((*mask.shape, 4 * HIDDEN), dtype=rows.dtype)
            recur = np.zeros_like(self.w[f"h{side}"])
            for t, h, c, i, f, o, g, squashed, on in reversed(kept[side]):
                dh = dh + into[t]
                own_c = on * (dc + dh * o * (1 - squashed**2))
                gates = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), on * dh * squashed * o * (1 - o), own_c * i * (1 - g**2)], axis=1)
                dx[t] = gates
                recur += h.T @ gates
                dh, dc = (1 - on) * dh + gates @ self.w[f"h{side}"].T, own_c * f + (1 - on) * dc
            grad[f"x{side}"] = np.einsum("tpw,tpg->wg", rows, dx, optimize=True)
            grad[f"h{side}"], grad[f"c{side}"] = recur, dx.sum((0, 1))
        return grad


def _stack(pages: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    rows, mask = np.zeros((steps, len(pages), WIDTH), dtype=dtype), np.zeros((steps, len(pages)), dtype=dtype)
    for i, page in enumerate(pages):
        rows[: len(page), i], mask[: len(page), i] = page, 1
    return rows, mask


def train(pages: int = 2400, rounds: int = 14, batch: int = 40, rate: float = 0.02, seed: int = SEED) -> Labeller:
    """Adam over made pages, in batches of pages of like length; the number of pages bounds the work."""
    from sievegrid.llm.page_maker import make_page

    rng, featurise = np.random.default_rng(seed), Features()
    made = [make_page(rng) for _ in range(pages)]
    cases = []
    for page, main in made:
        found = blocks(page)
        cases.append((featurise(found), np.array([text in main for _, text, _ in found], dtype=float)))
    model = Labeller(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    lengths = np.array([len(y) for _, y in cases])
    for turn in range(rounds):
        order = np.argsort(lengths * rng.uniform(0.8, 1.25, pages), kind="stable")
        for start in rng.permutation(np.arange(0, pages, batch)).tolist():
            part = [cases[i] for i in order[start : start + batch]]
            rows, mask = _stack([x for x, _ in part], np.float32)
            labels = np.zeros_like(mask)
            for i, (_, y) in enumerate(part):
                labels[: len(y), i] = y
            step += 1
            for k, g in model.gradients(rows, mask, labels).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = model.w[k] - rate * (1 - turn / rounds) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


_trained: dict[str, Labeller] = {}


def _weights_path(spark: SparkSession) -> str:
    """Weights are kept under a key of all that they follow from: generator, labeller and their parameters."""
    from sievegrid.llm import page_maker

    key = sha256("".join(map(inspect.getsource, (page_maker, Labeller, Features, train, blocks))).encode() + repr((PATHS, WIDTH, HIDDEN, SEED)).encode()).hexdigest()
    return f"{shared_folder(spark)}/maintext-weights-{key[:16]}"


def labeller(spark: SparkSession) -> Labeller:
    """The default weights: those of an earlier session in the shared folder, else trained by one task and kept there."""
    if not _trained:
        path = _weights_path(spark)
        if not exists(spark, f"{path}/_SUCCESS"):

            def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for _ in range(batch.num_rows):
                        w = train().w
                        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([x.ravel().tolist() for x in w.values()]), pa.array([list(x.shape) for x in w.values()])], names=["name", "numbers", "shape"])

            spark.range(1, numPartitions=1).mapInArrow(fit, "name string, numbers array<double>, shape array<long>").write.mode("overwrite").parquet(path)
        model = Labeller(np.random.default_rng(SEED))
        for x in spark.read.parquet(path).collect():
            model.w[x.name] = np.array(x.numbers).reshape(x.shape)
        _trained["default"] = model
    return _trained["default"]


#: Blocks of like-sized pages that are labelled at once, about.
_AT_ONCE = 4096


def main_texts(pages: list[str | None], model: Labeller, featurise: Features) -> list[str]:
    found = [blocks(x) for x in pages]
    kept: list[list[str]] = [[] for _ in pages]
    # (page, from, to, first and last block that this stretch decides)
    stretches = [(i, max(0, at - CONTEXT), min(len(x), at + STRETCH + CONTEXT), at, min(len(x), at + STRETCH)) for i, x in enumerate(found) for at in range(0, len(x), STRETCH)]
    order = sorted(stretches, key=lambda x: (x[2] - x[1], x[0], x[3]))
    main: dict[tuple[int, int], list[str]] = {}
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * (order[end][2] - order[end][1]) <= _AT_ONCE:
            end += 1
        group = order[start:end]
        for (i, low, _, first, last), said in zip(group, model.label([(found[i], low, high) for i, low, high, _, _ in group], featurise)):
            main[i, first] = [found[i][k][1] for k in range(first, last) if said[k - low]]
        start = end
    for (i, _), texts in sorted(main.items()):
        kept[i] += texts
    return ["\n\n".join(x) for x in kept]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``."""
    model = pages.sparkSession.sparkContext.broadcast(labeller(pages.sparkSession))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurise = Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(part.column(2).to_pylist(), model.value, featurise)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op8_maintext(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
