"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A block is seen through the tags and names around it and through its text. The
chain has two labels, main text and the rest; its weights are learned from the
labelled pages by gradient steps on their likelihood, and Viterbi decodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.html_blocks import Block, leaf_blocks
from codeloom.llm.labelled_pages import labelled_pages

STEPS = 300
RATE = 0.5
RIDGE = 1e-3

_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "head", "title", "li", "table", "button", "label", "section", "blockquote", "figure")
_OWN = ("p", "div", "h1", "h2", "h3", "li", "td", "article", "body")


def block_features(block: Block) -> list[str]:
    """Names of the features that a block has."""
    own = block.own
    text, size = block.text, len(block.text)
    found = ["bias", "own=" + (own if own in _OWN else "other")]
    found += ["in=" + t for t in _TAGS if t in block.tags]
    if block.bad:
        found.append("bad name")
    if block.good:
        found.append("good name")
    if not {"article", "main"} & block.tags and "good name" not in found:
        found.append("nothing good around")
    found.append("linked" if 2 * block.linked > size else "free")
    found.append("size=" + ("s" if size < 25 else "m" if size < 100 else "l"))
    found.append("sentence" if text[-1] in ".!?:;…”\"»" else "no end")
    if text[0] in "©•|" or "©" in text:
        found.append("sign")
    return found


class BlockModel:
    """Weights by feature, for main text against the rest, and weights of following labels."""

    def __init__(self, weights: dict[str, float], turns: np.ndarray):
        self.weights, self.turns = weights, turns

    def labels(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of a page."""
        (stay0, go1), (go0, stay1) = self.turns.tolist()
        no, yes, back = 0.0, 0.0, []
        for k, block in enumerate(blocks):
            score = sum(self.weights.get(f, 0.0) for f in block_features(block))
            if k == 0:
                no, yes = 0.0, score
                continue
            from_no, from_yes = no + stay0 >= yes + go0, no + go1 > yes + stay1
            back.append((not from_no, not from_yes))
            no, yes = max(no + stay0, yes + go0), score + max(no + go1, yes + stay1)
        if not blocks:
            return []
        label = yes > no
        out = [label]
        for if_no, if_yes in reversed(back):
            label = if_yes if label else if_no
            out.append(label)
        return out[::-1]


def train(pages: list[str], steps: int = STEPS) -> BlockModel:
    """Maximum likelihood with a ridge, by full gradient steps with momentum; forward-backward gives the expectations."""
    parsed = [p for p in map(leaf_blocks, pages) if p]
    names = sorted({f for blocks in parsed for b in blocks for f in block_features(b)})
    place = {f: k for k, f in enumerate(names)}
    longest = max(map(len, parsed))
    x = np.zeros((len(parsed), longest, len(names)))
    y, inside = np.zeros((len(parsed), longest), int), np.zeros((len(parsed), longest), bool)
    for i, blocks in enumerate(parsed):
        for t, b in enumerate(blocks):
            x[i, t, [place[f] for f in block_features(b)]] = 1
            y[i, t], inside[i, t] = b.main, True
    pairs = inside[:, 1:]
    w, turns = np.zeros(len(names)), np.zeros((2, 2))
    speed_w, speed_t = np.zeros_like(w), np.zeros_like(turns)
    seen_turns = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    total = inside.sum()
    for _ in range(steps):
        local = np.stack([np.zeros(inside.shape), x @ w], axis=-1)
        ahead, behind = np.zeros_like(local), np.zeros_like(local)
        ahead[:, 0] = local[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + turns[None], axis=1) + local[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(turns[None] + (local[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(inside[:, t + 1, None], step, 0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - whole[:, None, None])[..., 1] * inside
        both = np.exp(ahead[:, :-1, :, None] + turns + (local[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        slope_w = np.einsum("itf,it->f", x, (y * inside) - chance) / total - RIDGE * w
        slope_t = (seen_turns - (both * pairs[..., None, None]).sum(axis=(0, 1))) / total - RIDGE * turns
        speed_w, speed_t = 0.9 * speed_w + slope_w, 0.9 * speed_t + slope_t
        w, turns = w + RATE * speed_w, turns + RATE * speed_t
    return BlockModel(dict(zip(names, w.tolist(), strict=True)), turns)


def main_text(page: str | None, model: BlockModel) -> str:
    """Blocks of main text, joined by one space."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, main in zip(blocks, model.labels(blocks), strict=True) if main)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Null and empty pages, and those without main text, have an empty text. The
    whole page is read; unclosed and cut-off markup is allowed for. Equal pages
    get equal texts.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled_pages()))

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h, shared.value) for h in htmls], dtype=object)

    found = pages.select("page_id", "url", extract("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
