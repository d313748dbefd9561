"""The older alignment of a graph to its words: one word for a node, then spans of the nodes that belong together."""

from __future__ import annotations

import re

#: Fixed value: a concept without quotation marks and the number at its end.
BARE = re.compile(r'^"?(.+?)-?[0-9]*"?$')
#: Concepts whose span takes in those of the nodes below them.
TOGETHER = {
    "name", "country", "person", "date-entity", "organization", "city", "thing", "company", "monetary-quantity", "continent", "mass-quantity",
    "religious-group", "political-party", "distance-quantity", "criminal-organization", "research-institute", "date-interval", "temporal-quantity",
    "world-region", "ethnic-group", "university",
}
#: Letters that a word and a concept must share for a fuzzy match.
LEAST = 4


def bare(concept: str) -> str:
    if re.fullmatch("[0-9.]*", concept):
        return concept
    found = BARE.match(concept)
    return found[1] if found else concept


def shared(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def align_words(stems: list[list[str]], graph) -> dict[str, int]:
    """A word for each node that has one: the first free word with the concept among its stems, nodes in the order of the text;
    then for the others the first free one of those words that share most letters, if they share four."""
    _, nodes, _ = graph
    concepts = {at: bare(concept) for at, (_, concept) in nodes.items()}
    of: dict[str, int] = {}
    taken: set[int] = set()

    def take(at: str, words) -> None:
        word = next((i for i in words if i not in taken), None)
        if word is not None:
            of[at] = word
            taken.add(word)

    for at, concept in concepts.items():
        take(at, (i for i, own in enumerate(stems) if concept in own))
    for at, concept in concepts.items():
        if at not in of and stems:
            lengths = [max((shared(s, concept) for s in own), default=0) for own in stems]
            if max(lengths) >= LEAST:
                take(at, (i for i, n in enumerate(lengths) if n == max(lengths)))
    return of


def align_spans(words: int, graph, of: dict[str, int]) -> list[tuple[int, int, list[str]]]:
    """(start, stop, nodes) of each span: a node with a word is one, and a node of ``TOGETHER`` takes in its valid children's.

    A span is valid if no word in it belongs to another one met before. A node that has nothing to take in has an
    empty span (start after stop). Children are done before their parents, by a stack.
    """
    root, nodes, edges = graph
    below: dict[str, list[str]] = {}
    for source, _, target, kind in edges:
        if kind == "tree":
            below.setdefault(source, []).append(target)
    spans: list = []
    owner: dict[int, int] = {}
    found: dict[str, tuple[int, int, list[str]] | None] = {}
    todo: list[tuple[str, int | None, bool, int | None]] = [(root, None, False, None)]
    while todo:
        at, inside, done, index = todo.pop()
        wide = nodes[at][1] in TOGETHER
        if not done:
            found[at] = None
            if wide:
                index = inside
                if inside is None:
                    index = len(spans)
                    spans.append((words, 0, [at]))
            elif at in of:
                found[at] = (of[at], of[at] + 1, [at])
                owner[of[at]] = len(spans) if inside is None else inside
                if inside is None:
                    spans.append(found[at])
            if wide:
                todo.append((at, inside, True, index))
            todo += [(child, index if wide else None, False, None) for child in reversed(below.get(at, []))]
        else:
            start, stop, ids = words, 0, [at]
            for child in below.get(at, []):
                if found[child] is not None:
                    start, stop, ids = min(start, found[child][0]), max(stop, found[child][1]), ids + found[child][2]
            if inside is None:
                spans[index] = (start, stop, ids)
            found[at] = (start, stop, ids) if all(owner.get(i, index) == index for i in range(start, stop)) else None
    return spans
