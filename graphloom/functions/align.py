"""Alignment of graph nodes to words by an ordered list of rules, in plain Python for one sentence.

A rule either finds words for nodes that have none (``Finder``) or lets a node join the span of a neighbour (``Joiner``).
Rules run one after another over all nodes from the root down; each takes what earlier ones left. A span is a range of
words with the ids of the nodes it stands for; a word and a node are in one span at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import permutations

#: Words for digits and months.
NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Concepts that a lower-cased word stands for besides itself.
MEANINGS = {
    "/": ["slash"], ";": ["and"], ":": ["mean"], "!": ["expressive"], "..": ["expressive"], "...": ["expressive"], "....": ["expressive"], "?": ["interrogative"],
    "%": ["percentage-entity"], "able": ["possible"], "according": ["say"], "also": ["include"], "anti": ["oppose", "counter"], "anyway": ["have-concession"],
    "as": ["same"], "because": ["cause"], "but": ["contrast", "have-concession"], "can": ["possible"], "cant": ["possible"], "can't": ["possible"],
    "choice": ["choose"], "could": ["possible"], "death": ["die"], "french": ["france", "France"], "have": ["obligate"], "her": ["she"], "his": ["he"],
    "how": ["amr-unknown"], "if": ["cause"], "illegal": ["law"], "like": ["resemble"], "life": ["live"], "may": ["possible"], "me": ["i"], "might": ["possible"],
    "my": ["i"], "n't": ["-"], "no": ["-"], "non": ["-"], "not": ["-"], "of": ["include", "have-manner"], "ok": ["okay"], "o.k.": ["okay"], "our": ["we"],
    "people": ["person"], "similar": ["resemble"], "since": ["cause"], "should": ["recommend"], "so": ["infer", "cause"], "speech": ["speak"],
    "statement": ["state"], "them": ["they"], "these": ["this"], "those": ["that"], "thought": ["think"], "thoughts": ["think"], "uni": ["university"],
    "well": ["good"], "what": ["amr-unknown"], "who": ["amr-unknown"],
}
#: Words of negation, and what words that carry one look like.
NEGATIONS = ("no", "not", "non", "nt", "n't")
NEGATIVE = "un.*|in.*|il.*|.*less|.*n't|.*nt"
ROLES = "have-org-role-91|have-rel-role-91"
#: How many words, concepts and labels a task remembers: bounds memory, bears on time alone.
REMEMBERED = 1 << 14
#: Shortest beginning that two words share for a loose match.
SHARED = 4


@lru_cache(REMEMBERED)
def looks(pattern: str, text: str) -> bool:
    return re.fullmatch(pattern, text) is not None


@lru_cache(REMEMBERED)
def bare(concept: str) -> str:
    """A concept without quotes and sense number; numbers stay (quoted ones keep their first digit only)."""
    if re.fullmatch(r"[0-9.]*", concept):
        return concept
    found = re.fullmatch(r'"?(.+?)-?[0-9]*"?', concept)
    return found[1] if found else concept


def readings(word: str, lexicon: dict[str, list[str]] | None = None) -> tuple[str, ...]:
    """What a word may stand for: itself, numbers, meanings, without affixes, and its stems in ``lexicon``."""
    return read_as(word, tuple((lexicon or {}).get(word, ())))


@lru_cache(REMEMBERED)
def read_as(word: str, stems: tuple[str, ...]) -> tuple[str, ...]:
    low, found = word.lower(), [word, word.lower()]
    found += [NUMBERS[low]] if low in NUMBERS else []
    found += [str(MONTHS.index(word) + 1)] if word in MONTHS else []
    for ending, cut in (("ers", 3), ("er", 2)):
        found += [word[:-cut]] if low.endswith(ending) else []
    found += [word[2:]] if low.startswith(("in", "un", "ir")) else []
    found += [*MEANINGS.get(low, []), *stems]
    return tuple(dict.fromkeys(found))


def shared_beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


@lru_cache(REMEMBERED)
def closest(found: tuple[str, ...], concept: str) -> int:
    """The longest beginning that one of a word's readings shares with the concept."""
    return max(shared_beginning(r, concept) for r in found)


@dataclass
class Span:
    start: int
    stop: int
    nodes: list[str]


@dataclass
class State:
    """A sentence, its graph and the spans so far. Nodes have Gorn ids; children are those in the tree."""

    words: list[str]
    concepts: dict[str, str]
    children: dict[str, list[tuple[str, str]]]
    lexicon: dict[str, list[str]] | None = None
    spans: list[Span] = field(default_factory=list)
    of_node: dict[str, Span] = field(default_factory=dict)
    of_word: dict[int, Span] = field(default_factory=dict)

    def __post_init__(self):
        self.readings = [readings(w, self.lexicon) for w in self.words]
        self.line = "\t" + "\t".join(self.words).lower() + "\t"
        # Where a reading stands, and the nodes from the root down: neither changes.
        self.words_of: dict[str, list[int]] = {}
        for i, found in enumerate(self.readings):
            for r in found:
                self.words_of.setdefault(r, []).append(i)
        self.order = list(self.walk())

    @cached_property
    def dated(self) -> str:
        dated = self.line
        for k, month in enumerate(MONTHS, 1):
            dated = dated.replace(month.lower(), str(k))
        return re.sub(r"[^0-9a-z\t]", "", dated)

    def walk(self, at: str = "0") -> Iterator[str]:
        todo = [at]
        while todo:
            at = todo.pop()
            yield at
            todo += [child for _, child in reversed(self.children.get(at, []))]

    def labelled(self, at: str, label: str) -> list[str]:
        return [child for name, child in self.children.get(at, ()) if looks(label, name)]

    def put(self, span: Span, start: int, stop: int, nodes: list[str]) -> None:
        """Gives a span these words and nodes; what it had before is free."""
        for w in range(span.start, span.stop):
            if self.of_word.get(w) is span:
                del self.of_word[w]
        for n in span.nodes:
            if self.of_node.get(n) is span:
                del self.of_node[n]
        span.start, span.stop, span.nodes = start, stop, nodes
        self.of_word.update((w, span) for w in range(start, stop))
        self.of_node.update((n, span) for n in nodes)

    def free(self, start: int, stop: int, nodes: list[str]) -> bool:
        return not any(w in self.of_word for w in range(start, stop)) and not any(n in self.of_node for n in nodes)

    def closeness(self, concept: str) -> list[int]:
        """For each word the longest beginning that one of its readings shares with the concept."""
        return [closest(found, concept) for found in self.readings]


def ranges(pattern: str, line: str) -> list[tuple[int, int]]:
    """Word ranges of the matches in a line of words with tabs around each."""
    return [(line.count("\t", 0, m.start()), line.count("\t", 0, m.end()) - 1) for m in re.finditer(pattern, line)]


def letters(text: str) -> str:
    """A pattern for a text whose characters may be spread over words."""
    return "\t?".join(map(re.escape, text))


@dataclass(frozen=True)
class Finder:
    """``find(state, node)`` gives node ids and word ranges; the first range that is free becomes a span."""

    name: str
    concept: Callable[[str], bool]
    find: Callable[[State, str], tuple[list[str], list[tuple[int, int]]]]

    def run(self, state: State) -> None:
        for at in state.order:
            if at in state.of_node or not applies(self, state.concepts[at]):
                continue
            nodes, found = self.find(state, at)
            for start, stop in found:
                if start < stop and state.free(start, stop, nodes):
                    span = Span(start, stop, [])
                    state.spans.append(span)
                    state.put(span, start, stop, nodes)
                    break


@dataclass(frozen=True)
class Joiner:
    """``join(state, node)`` changes spans for a node whose concept matches."""

    name: str
    concept: str
    join: Callable[[State, str], None]
    unaligned: bool = True

    def run(self, state: State) -> None:
        for at in state.order:
            if not (self.unaligned and at in state.of_node) and looks(self.concept, state.concepts[at]):
                self.join(state, at)


@lru_cache(REMEMBERED)
def applies(rule: Finder, concept: str) -> bool:
    return rule.concept(concept)


# Names -------------------------------------------------------------------------------------------


def name_by(pattern: Callable[[State, list[str]], str]):
    def find(state, at):
        ops = state.labelled(at, ":op.*")
        return ([at, *ops], ranges(pattern(state, ops), state.line)) if ops else ([], [])

    return find


def whole_name(state, ops):
    return "\t" + "[^a-zA-Z]*".join(letters(bare(state.concepts[x]).lower()) for x in ops) + "\t"


def initials(state, ops):
    return "\t" + "[^a-zA-Z]*".join(re.escape(bare(state.concepts[x])[:1].lower()) for x in ops) + "\t"


def loose_name(state, ops):
    def begin(x):
        concept = bare(state.concepts[x])
        return letters(concept.lower()[: max(SHARED, *state.closeness(concept))])

    return "\t" + "[^\t]*[^a-zA-Z]*".join(map(begin, ops)) + "[^\t]*\t"


def united_states(state, at):
    wanted = {":op1": "United", ":op2": "States"}
    kids = [child for label, child in state.children.get(at, []) if bare(state.concepts[child]) == wanted.get(label, bare(state.concepts[child]))]
    return ([at, *kids], ranges("\tus\t|\tu[.]\t?s[.]\t", state.line)) if len(kids) == len(wanted) else ([], [])


def date(state, at):
    parts = {x: state.labelled(at, f":{x}") for x in ("year", "month", "day")}
    ids = [child for label, child in state.children.get(at, []) if re.fullmatch(":year|:month|:day", label)]
    if not ids:
        return [], []
    values = {x: state.concepts[found[0]] for x, found in parts.items() if found}
    every = ["\t0*" + "\t*0*".join(map(re.escape, order)) + "\t" for order in permutations(values.values())]
    packed = "".join(values.get(x, "")[-2:].rjust(2, "0") for x in ("year", "month", "day"))
    return [at, *ids], ranges("|".join([*every, f"\t{re.escape(packed)}\t"]), state.dated)


# Single concepts ---------------------------------------------------------------------------------


def is_word(concept: str) -> bool:
    return bool(re.match("[^-]", bare(concept)))


def same_word(state, at):
    concept = bare(state.concepts[at])
    free = [i for i in state.words_of.get(concept, ()) if i not in state.of_word]
    return [at], [(i, i + 1) for i in free[:1]]


def like_word(state, at):
    close = state.closeness(bare(state.concepts[at]))
    most = max(close, default=0)
    free = [i for i, n in enumerate(close) if n == most and i not in state.of_word] if most >= SHARED else []
    return [at], [(i, i + 1) for i in free[:1]]


def negation(state, at):
    return [at], ranges("|".join(f"\t{re.escape(w)}\t" for w in NEGATIONS), state.line)


# Joining -----------------------------------------------------------------------------------------


def collect_all(state, at):
    """All parts of a name are aligned: one span over all of them."""
    kids = [child for _, child in state.children.get(at, [])]
    if not kids or len(state.labelled(at, ":op.*")) != len(kids) or not all(k in state.of_node for k in kids):
        return
    own = [state.of_node[k] for k in kids]
    start, stop = min(s.start for s in own), max(s.stop for s in own)
    for s in own[1:]:
        if s is not own[0]:
            state.put(s, 0, 0, [])
    state.put(own[0], start, stop, [at, *kids])


def collect_one(state, at):
    """One part of a name is aligned: its span is the name's."""
    kids = [child for _, child in state.children.get(at, [])]
    have = [k for k in kids if k in state.of_node]
    if len(have) == 1 and len(state.labelled(at, ":op.*")) == len(kids):
        span = state.of_node[have[0]]
        state.put(span, span.start, span.stop, [at, *kids])


def with_child(label: str, most: int = 1000):
    """The node joins the span of its first child with such a label."""

    def join(state, at):
        kids = state.labelled(at, label)
        if kids and len(kids) <= most and kids[0] in state.of_node:
            span = state.of_node[kids[0]]
            state.put(span, span.start, span.stop, [at, *span.nodes])

    return join


def take_child(label: str, words: str = ".*"):
    """The first child with such a label joins the node's span if it has none and the span's words look like that."""

    def join(state, at):
        kids, span = state.labelled(at, label), state.of_node.get(at)
        if kids and span and kids[0] not in state.of_node and re.fullmatch(words, "\t".join(state.words[span.start : span.stop])):
            state.put(span, span.start, span.stop, [*span.nodes, kids[0]])

    return join


def named(concept: str):
    return lambda c: c == concept


ROLE_ARG2 = Joiner("haveRoleArg2", ROLES, with_child(":ARG2"))
ORG_ARG1 = Joiner("haveOrgRoleArg1", "have-org-role-91", with_child(":ARG1"))
#: The rules in the order in which they run.
RULES: list[Finder | Joiner] = [
    Finder("namedEntity", named("name"), name_by(whole_name)),
    Finder("fuzzyNamedEntity", named("name"), name_by(loose_name)),
    Finder("dateEntity", named("date-entity"), date),
    Finder("singleConcept", is_word, same_word),
    Finder("fuzzyConcept", lambda c: is_word(c) and not re.fullmatch(ROLES, c), like_word),
    Finder("US", named("name"), united_states),
    Finder("namedEntityAcronym", named("name"), name_by(initials)),
    Joiner("namedEntityCollect", "name", collect_all),
    Joiner("namedEntityCollectSingle", "name", collect_one),
    Joiner("unalignedEntity", ".*", with_child(":name")),
    ROLE_ARG2,
    ORG_ARG1,
    Joiner("quantity", ".*-quantity", with_child(":unit")),
    Joiner("argOf", "person|thing", with_child(":.*-of")),
    Joiner("personOf", "person", with_child(":.*", 1)),
    Joiner("governmentOrg", "government-organization", take_child(":ARG.*-of"), unaligned=False),
    Finder("minusPolarity", named("-"), negation),
    Joiner("polarityChild", ".*", take_child(":polarity", NEGATIVE), unaligned=False),
    Joiner("est", ".*", take_child(":degree", ".*est"), unaligned=False),
    ROLE_ARG2,
    ORG_ARG1,
    Joiner("wiki", ".*", take_child(":wiki"), unaligned=False),
]


def align(words: list[str], graph, lexicon: dict[str, list[str]] | None = None, rules=None) -> list[Span]:
    """The spans of a sentence, in the order they were found; ``graph`` is as ``penman.read`` gives it."""
    _, nodes, edges = graph
    children: dict[str, list[tuple[str, str]]] = {}
    for source, label, target, kind in edges:
        if kind == "tree":
            children.setdefault(source, []).append((label, target))
    state = State(list(words), {k: concept for k, (_, concept) in nodes.items()}, children, lexicon)
    if words:
        for rule in RULES if rules is None else rules:
            rule.run(state)
    return [s for s in state.spans if s.start < s.stop]


def show(spans: list[Span]) -> str:
    """``start-stop|id+id`` of each span, ids in the order of strings."""
    return " ".join(f"{s.start}-{s.stop}|{'+'.join(sorted(s.nodes))}" for s in spans)
