"""HTML extraction (13): content of a page by sum-product over its DOM tree.

A page is a tree of block elements with runs of text as leaves (``dom``). Each node is content or not. A node's potential comes
from its features (its element and its parent's, words in class and id, length, links, sentences, place), and each edge
has a potential for the four cases of parent and child. Messages go from the leaves up and from the root down, which gives
every node's marginal in one pass each; the leaves whose marginal says content are the page's text.

The weights are those of the greatest likelihood on labelled pages: the gradient is what the labels have of each feature
and case less what the marginals expect of it. The labels: pages of the table that say by their elements what is the
article (at most ``Settings.pages`` of at most ``page_bytes`` bytes, those of the smallest hashes), and pages put together from texts of
these in the layouts and names that sites use (``layouts``), labelled as they are made. A table without such pages is
learned from the second kind alone. All pages of the table are extracted, whole.

Defined cases: a missing or empty page, and one without content, has an empty text. Very long and very deep pages are read whole.
Pages that repeat an id or a body are extracted each. An empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulse.llm import layouts
from pulse.llm.dom import EDGES, NAMES, Forest, Page, attributes, parse
from pulse.llm.shared import bounded_sample
from pulse.llm.words import pieces, texts


@dataclass(frozen=True)
class Settings:
    #: Labelled pages out of the table, and their bytes at most.
    pages: int = 200
    page_bytes: int = 1 << 16
    #: Labelled pages that are put together.
    made: int = 900
    rounds: int = 200
    rate: float = 0.1
    penalty: float = 0.02
    threshold: float = 0.5
    #: Bytes of pages that a task works on at a time.
    piece: int = 1 << 21


# --- the model ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Weights of the features, and for each kind of edge the potential of (parent, child)."""

    weights: np.ndarray
    edges: np.ndarray


def marginals(forest: Forest, model: Model, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each node's probability of content, and on demand the joint ones of each edge (node, parent's state, own state)."""
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = forest.scores(model.weights)
    by_edge = model.edges[forest.edges]
    up = np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        with_child = belief[level][:, None, :] + by_edge[level]
        up[level] = np.logaddexp(with_child[:, :, 0], with_child[:, :, 1])
        np.add.at(belief, forest.parent[level], up[level])
    joint = np.zeros((n, 2, 2)) if pairs else None
    for level in forest.levels[1:]:
        # What the parent knows without this child.
        rest = belief[forest.parent[level]] - up[level]
        both = rest[:, :, None] + by_edge[level]
        if pairs:
            all_of = both + belief[level][:, None, :]
            all_of -= all_of.max((1, 2), keepdims=True)
            joint[level] = np.exp(all_of)
            joint[level] /= joint[level].sum((1, 2), keepdims=True)
        belief[level] += np.logaddexp(both[:, 0], both[:, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def fitted(pages: list[Page], labels: list[np.ndarray], settings: Settings = Settings()) -> Model:
    """The model of the greatest likelihood, with a penalty on large weights."""
    forest = Forest.of(pages)
    truth = np.concatenate(labels)
    below = forest.parent >= 0
    above = truth[forest.parent[below]]
    cells = forest.edges[below] * 4 + above * 2 + truth[below]
    seen_edges = np.bincount(cells, minlength=EDGES * 4).reshape(EDGES, 2, 2).astype(float)
    seen = forest.totals(truth.astype(float))
    weights, edges = np.zeros(len(NAMES)), np.zeros((EDGES, 2, 2))
    model, moments = Model(weights, edges), [np.zeros((2, len(NAMES))), np.zeros((2, EDGES, 2, 2))]
    for step in range(1, settings.rounds + 1):
        each, joint = marginals(forest, model, pairs=True)
        expected = np.stack([joint[below & (forest.edges == k)].sum(0) for k in range(EDGES)])
        slopes = [seen - forest.totals(each), seen_edges - expected]
        for value, slope, moment in zip((weights, edges), slopes, moments):
            slope = slope / len(pages) - settings.penalty * value
            moment[0] = 0.9 * moment[0] + 0.1 * slope
            moment[1] = 0.99 * moment[1] + 0.01 * slope**2
            value += settings.rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return model


# --- labelled pages ------------------------------------------------------------------------

_YES, _NO = frozenset(("article", "main")), frozenset("nav header footer aside form dialog".split())


def _marked(tag: str, attrs: str, above: int) -> int:
    """What a labelled page says of an element: its own label, or by its name, or what its parent is."""
    found = attributes(attrs) if "data-label" in attrs else {}
    if "data-label" in found:
        return int(found["data-label"])
    if above < 2 and tag in _NO and not (tag == "header" and above == 1):
        return 0
    return 1 if tag in _YES and above != 0 else above


def labels_of(page: Page) -> np.ndarray:
    """1 for leaves of the article, and for elements most of whose words are; 0 for the others."""
    said, content = [], np.zeros(len(page.nodes), np.int64)
    for node in page.nodes:
        above = said[node.parent] if node.parent >= 0 else -1
        said.append(_marked(node.tag, node.attributes, above) if node.text is None else above)
    for place in range(len(page.nodes) - 1, -1, -1):
        node = page.nodes[place]
        if node.text is not None:
            content[place] = node.words if said[place] == 1 else 0
        if node.parent >= 0:
            content[node.parent] += content[place]
    return (2 * content > np.array([node.words for node in page.nodes])).astype(np.int64)


def _says_its_article(page: Page) -> bool:
    return sum(node.tag in _YES for node in page.nodes) == 1


def trained(pages: DataFrame, settings: Settings = Settings()) -> Model:
    """The model from a bounded sample of the table's pages and from pages made of their texts."""
    sample = bounded_sample(pages.select("page_id", "html"), settings.pages, "page-sample", "html", settings.page_bytes)
    # In an order of their own, so that the model is the same in every run.
    found = [parse(row["html"]) for row in sorted(sample.select("html").collect())]
    stock = [node.text for page in found for node in page.nodes if node.text is not None and node.words >= 5]
    made = [parse(text) for text in layouts.pages(random.Random(13), stock, settings.made)]
    own = [page for page in found if _says_its_article(page)]
    learned = [page for page in own + made if page.nodes]
    return fitted(learned, [labels_of(page) for page in learned], settings)


# --- extraction ----------------------------------------------------------------------------

SCHEMA = "page_id long, url string, text string, n_chars long, score double"


def contents(parsed: list[Page], model: Model, threshold: float = 0.5) -> Iterator[tuple[str, float]]:
    """For each page its text, and the mean marginal of the leaves in it."""
    sure, _ = marginals(Forest.of(parsed), model)
    first = 0
    for page in parsed:
        own = sure[first : first + len(page.nodes)]
        first += len(page.nodes)
        chosen = [(node.text, p) for node, p in zip(page.nodes, own.tolist()) if node.text is not None and p >= threshold]
        yield "\n\n".join(text for text, _ in chosen), (sum(p for _, p in chosen) / len(chosen) if chosen else 0.0)


def extracted(pages: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """page_id, url, the main text, its length in code points, and the mean marginal of its blocks."""
    model = model or trained(pages, settings)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html", settings.piece):
            rows = list(contents([parse(text) for text in texts(piece, "html")], model, settings.threshold))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("page_id").cast(pa.int64()),
                    piece.column("url"),
                    pa.array([text for text, _ in rows], pa.string()),
                    pa.array([len(text) for text, _ in rows], pa.int64()),
                    pa.array([score for _, score in rows], pa.float64()),
                ],
                names=["page_id", "url", "text", "n_chars", "score"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, SCHEMA)
