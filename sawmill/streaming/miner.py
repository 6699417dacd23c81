"""Sequential template mining as a stateful operator: messages one after the other, templates that live on, a log of all changes.

``mining.mine`` gives one result for a set of lines. Here the result follows the lines in their order, as they come: a message is matched with the templates so far or makes a new one, which is
merged with near ones, absorbs those it covers, and is split when its lines reach its limit. State is kept for each key (dataset; narrower keys are parallel and never merge over
their borders) by ``transformWithStateInPandas``: samples, templates with their limits, and the samples of each template. So a stream goes on where its checkpoint ends, and the same function runs over
a finished table.

What leaves the operator is the log of changes, as later lines rewrite earlier assignments. ``templates_now``, ``samples_now`` and ``relabelled`` read it with
plain aggregates; lines get their events by joining on sample_id.

Lines of one key go through one task in their order; that is what the rule asks for. Of a finished table a task holds the templates, the samples that come again in later lines, and values of gaps
with wildcards; the samples of each template are on disk and are read in turn where a template is split. Of a stream it holds the samples of the templates that a batch changes. For one large log without need for the order use ``mining.mine``.

Defined cases: null content is skipped; lines of a batch are taken by line_no, and equal numbers in the order of their text; a text known as a sample is not matched again; a template of text
without letters is not merged; two branches whose values become one after normalising share their samples; an empty table gives no changes.
"""

from __future__ import annotations

import heapq
import marshal
import math
import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Generator, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sawmill.operators import lcs
from sawmill.operators.extract import collapsed, matcher
from sawmill.operators.mining import NEAR, SPLIT_BASE
from sawmill.plans.tables import shared_dir

WILDCARD, EMPTY_GAP = "<*>", "{V}"
_WORDS, _LETTER = re.compile(r"\w+"), re.compile("[a-zA-Z]")
_COLUMNS = ["at", "line_no", "kind", "template_id", "template_text", "sample_limit", "sample_id", "from_id", "reason"]
_NUMBERS = {"at", "line_no", "template_id", "sample_limit", "sample_id", "from_id"}
#: Changes that leave a task at a time.
LOGGED = 100_000
LOG = "at long, line_no long, kind string, template_id long, template_text string, sample_limit long, sample_id long, from_id long, reason string"


def has_letter(text: str) -> bool:
    return _LETTER.search(text.replace(WILDCARD, "")) is not None


@lru_cache(1 << 16)
def _tokens(text: str) -> tuple[tuple[str, ...], Counter, int]:
    tokens = tuple(lcs.tokenize(text))
    words = Counter(t for t in tokens if lcs.is_word(t))
    return tokens, words, words.total()


def _near(a: str, b: str) -> bool:
    """Whether the distance is within NEAR; words in common, whatever their order, bound it from below."""
    (_, x, n), (_, y, m) = _tokens(a), _tokens(b)
    most = max(n, m)
    return most > 0 and 1 - min(n, m) / most <= NEAR + 1e-9 and 1 - (x & y).total() / most <= NEAR + 1e-9 and lcs.distance(a, b) <= NEAR


def cluster_of_last(texts: Sequence[str]) -> list[int]:
    """Places of the texts in the cluster of the last one: reachable by steps between rows of the distance matrix (32-bit) that are within NEAR."""
    n = len(texts)
    rows = np.zeros((n, n), np.float32)
    for i in range(n):
        for j in range(i):
            rows[i, j] = rows[j, i] = lcs.distance(texts[j], texts[i])
    wide = rows.astype(float)
    reached, open_ = {n - 1}, [n - 1]
    while open_:
        step = np.sqrt(((wide - wide[open_.pop()]) ** 2).sum(1)) <= NEAR
        new = set(np.flatnonzero(step).tolist()) - reached
        reached |= new
        open_ += new
    return sorted(reached)


def merged_text(texts: Sequence[str]) -> str:
    """The common runs of the texts in turn, joined by wildcards; one before or after them where not all texts match without."""
    runs = lcs.fold_all(map(lcs.tokenize, texts))
    base = WILDCARD.join("".join(r) for r in runs)
    for form in (base, WILDCARD + base, base + WILDCARD):
        if all(matcher(form)(t) for t in texts):
            break
    else:
        form = WILDCARD + base + WILDCARD
    return collapsed(form)


def _covering(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """groups of texts by value, where a value whose pattern matches another one takes its texts, in the order of the values."""
    groups = {k: list(v) for k, v in groups.items()}
    for text in groups:
        if WILDCARD in text:
            for other, some in groups.items():
                if other != text and matcher(text)(other):
                    groups[text] += some
                    groups[other] = []
    return {k: v for k, v in groups.items() if v}


def _covered(text: str, wild: Sequence[str]) -> str:
    """The value that has a value's texts after ``_covering``; wild: the values with a wildcard, in their order."""
    for by in wild:
        if by != text and matcher(by)(text):
            text = by
    return text


class _Values:
    """The values of a gap, in the order of the texts, as far as they tell its branches: those with a wildcard or placeholder, and of the others one more than there may be."""

    def __init__(self, most: int):
        self.most, self.wild, self.seen, self.plain = most, [], {}, 0
        self.ends: set[str] | None = None  # values that keep samples; None while all values are

    def add(self, value: str) -> None:
        if value not in self.seen and ("<" in value or self.plain <= self.most):
            self.seen[value] = None
            if WILDCARD in value:
                self.wild.append(value)
            self.plain += "<" not in value

    def whole(self) -> bool:
        """Whether all values are known that matter: without wildcards none takes another in."""
        return not self.wild or self.plain <= self.most

    def anew(self) -> None:
        """The texts come again: with the wildcards known, values that they take in needn't be held."""
        self.ends, self.plain = set(), 0
        self.seen = {v: None for v in self.seen if "<" in v}
        self.first = dict.fromkeys(self.seen, -1)
        self.at = 0

    def add_anew(self, value: str) -> None:
        self.at += 1
        if "<" in value:
            if self.first[value] < 0:
                self.first[value] = self.at
        elif value in self.seen:
            return
        end = _covered(value, self.wild)
        if "<" not in end:
            if self.plain > self.most:
                return
            self.seen[end], self.first[end] = None, self.at
            self.plain += 1
        self.ends.add(end)

    def name(self, value: str) -> str:
        value = _covered(value, self.wild)
        # placeholders and wildcards begin with <
        return collapsed(lcs.PLACEHOLDER.sub(WILDCARD, value)) if "<" in value else value

    def names(self) -> list[str]:
        """What the values are called, in order; more than ``most`` if there are too many."""
        if self.ends is None:
            ends = {_covered(v, self.wild) for v in self.seen}
            return list(dict.fromkeys(self.name(v) for v in self.seen if v in ends))
        left = sorted((v for v in self.seen if v in self.ends), key=self.first.get)
        return list(dict.fromkeys(self.name(v) for v in left))


#: Shapes of texts whose gaps are kept.
SHAPES = 50_000


def branch_names(read: Callable[[], Iterator[str]], most: int) -> tuple[list[str], Callable[[str], str]] | None:
    """Templates by the value of the gap with the fewest values between the common runs (weighted), and what tells a text's template; None if no gap has at most ``most``.

    ``read`` gives the texts, anew for each pass; they aren't held.
    """
    runs = lcs.fold_all(map(lcs.tokenize, read()), weighted=True)
    known = {t for r in runs for t in r}
    spans: dict[tuple[str, ...], list[tuple[int, int]]] = {}  # by shape

    def gaps(text: str) -> tuple[list[str], list[tuple[int, int]]]:
        tokens = lcs.tokenize(text)
        if (found := spans.get(own := lcs.shape(tokens, known))) is None:
            if len(spans) >= SHAPES:
                spans.clear()
            found = spans[own] = lcs.gap_places(tokens, runs)
        return tokens, found

    table = [_Values(most) for _ in range(len(runs) + 1)]
    for text in read():
        tokens, found = gaps(text)
        for values, (a, b) in zip(table, found):
            values.add("".join(tokens[a:b]))
    open_ = [k for k, v in enumerate(table) if not v.whole()]
    if open_:
        for k in open_:
            table[k].anew()
        for text in read():
            tokens, found = gaps(text)
            for k in open_:
                table[k].add_anew("".join(tokens[found[k][0] : found[k][1]]))
    names = [v.names() for v in table]
    able = [(len(v), k) for k, v in enumerate(names) if 1 < len(v) <= most and any(map(has_letter, v))]
    if not able:
        return None
    chosen = min(able)[1]
    fixed = [v[0] if len(v) == 1 else WILDCARD for v in names]
    full: dict[str, str | None] = {}
    for value in names[chosen]:
        own = EMPTY_GAP if not value and chosen else value
        parts = [piece for k, f in enumerate(fixed) for piece in (own if k == chosen else f, "".join(runs[k]) if k < len(runs) else "")]
        name = collapsed("".join(parts))
        full[value] = name if has_letter(name) else None  # without a letter, each sample is its own template

    def value_of(text: str) -> str:
        tokens, found = gaps(text)
        a, b = found[chosen]
        return "".join(tokens[a:b])

    alone: dict[str, list[str]] = {v: [] for v, name in full.items() if name is None}
    if alone:
        groups: dict[str, list[str]] = {}
        for text in read():
            value = value_of(text)
            if (own := table[chosen].name(value) in alone) or WILDCARD in value:
                groups.setdefault(value, []).extend([text] * own)
        for value, some in _covering(groups).items():
            alone[table[chosen].name(value)] += some
    every = dict.fromkeys(text for value, name in full.items() for text in (alone[value] if name is None else [name]))
    wild = [name for name in every if WILDCARD in name]
    to = {name: _covered(name, wild) for name in every}
    ends = set(to.values())
    return [name for name in every if name in ends], lambda text: to[full[table[chosen].name(value_of(text))] or text]


def branches(texts: Sequence[str], most: int) -> list[tuple[str, list[int]]]:
    """``branch_names`` of these texts, with the places of each template's texts; one template if no gap has at most ``most`` values."""
    found = branch_names(lambda: iter(texts), most)
    if found is None:
        return [("", list(range(len(texts))))]
    out: dict[str, list[int]] = {name: [] for name in found[0]}
    for place, text in enumerate(texts):
        out[found[1](text)].append(place)
    return list(out.items())


#: Rows that lists hold in memory together, before they are written.
HELD = 20_000


class _Lists:
    """Lists of rows that only grow, in one file without a name; the last rows are in memory."""

    def __init__(self):
        self.file, self.blocks, self.rest, self.held, self.next = None, {}, {}, 0, 0

    def new(self) -> int:
        self.next += 1
        return self.next

    def add(self, of: int, row: tuple) -> None:
        self.rest.setdefault(of, []).append(row)
        self.held += 1
        if self.held >= HELD:
            if self.file is None:
                # where the executor spills
                found = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
                self.file = tempfile.TemporaryFile(dir=found[0] if found else None)
            for k, rows in self.rest.items():
                block = marshal.dumps(rows)
                self.blocks.setdefault(k, []).append((self.file.seek(0, 2), len(block)))
                self.file.write(block)
            self.rest, self.held = {}, 0

    def rows(self, of: int) -> Iterator[tuple]:
        """As they are now, though lists may grow meanwhile."""
        blocks, rest = list(self.blocks.get(of, ())), list(self.rest.get(of, ()))
        for at, size in blocks:
            self.file.seek(at)
            yield from marshal.loads(self.file.read(size))
        yield from rest

    def drop(self, of: int) -> None:
        self.blocks.pop(of, None)
        self.held -= len(self.rest.pop(of, ()))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _State:
    """The state of one key during one call: templates in memory, samples and members as they are asked for; ``save`` writes what changed.

    A row is (first line, sample, text, lines), the members of a template are in the order of first lines.
    """

    def __init__(self, handles):
        self.h = handles
        self.next, self.at = self.h["counters"].get() if self.h["counters"].exists() else (0, 0)
        self.fresh = not self.next
        self.templates = {} if self.fresh else {k[0]: list(v) for k, v in self.h["templates"].iterator()}  # id: text, limit, lines
        self.templates = dict(sorted(self.templates.items()))
        self.samples: dict[int, list] = {}  # id: template, lines, first line
        self.members: dict[int, dict[int, str]] = {}  # template: sample id: text
        self.lists = _Lists()
        self.log: list[tuple] = []
        self.changed: set[int] = set()
        self.left: set[int] = set()
        self.line = 0

    def sample(self, i: int) -> list | None:
        if i not in self.samples and not self.fresh and (found := self.h["samples"].getValue((i,))) is not None:
            self.samples[i] = list(found)
        return self.samples.get(i)

    def members_of(self, t: int) -> dict[int, str]:
        if t not in self.members:
            found = None if self.fresh else self.h["members"].getValue((t,))
            self.members[t] = dict(zip(*found)) if found is not None else {}
        return self.members[t]

    def rows(self, t: int) -> Iterator[tuple]:
        for i, text in self.members_of(t).items():
            _, lines, first = self.sample(i)
            yield first, i, text, lines

    def put(self, t: int, row: tuple) -> None:
        """A row that comes after the others of the template."""
        self.members_of(t)[row[1]] = row[2]
        self.changed.add(t)

    def again(self, t: int, text: str) -> None:
        """A further line of a text of the template."""

    def gather(self, t: int, lists: Sequence[int]) -> None:
        """Rows of other lists become rows of the template."""
        of = self.members_of(t) | {row[1]: row[2] for k in lists for row in self.lists.rows(k)}
        self.members[t] = dict(sorted(of.items(), key=lambda m: self.sample(m[0])[2]))
        self.changed.add(t)
        for k in lists:
            self.lists.drop(k)

    def note(self, kind: str, reason: str, template: int, text=None, limit=None, sample=None, origin=None) -> None:
        self.log.append((self.at, self.line, kind, template, text, limit, sample, origin, reason))
        self.at += 1

    def move(self, rows: Iterator[tuple], origin: int, to: int, reason: str) -> Generator[None, None, int]:
        """Assigns the samples of a template to another one, which still has to gather them: their list. Yields where the log is to leave."""
        kept = self.lists.new()
        for row in rows:
            if row[1] is not None:
                self.note("sample", reason, to, sample=row[1], origin=origin)
                if (found := self.sample(row[1])) is not None:
                    found[0] = to
                if len(self.log) >= LOGGED:
                    yield
            self.templates[to][2] += row[3]
            self.lists.add(kept, row)
        return kept

    def drop(self, template: int, into: int | None, reason: str) -> None:
        self.note("gone", reason, template, origin=into)
        del self.templates[template]
        self.members.pop(template, None)
        self.changed.discard(template)
        self.left.add(template)

    def insert(self, text: str, limit: int, reason: str) -> int:
        t, self.next = self.next, self.next + 1
        self.templates[t] = [text, limit, 0]
        self.members[t] = {}
        self.note("template", reason, t, text, limit)
        return t

    def save(self) -> None:
        for i, v in self.samples.items():
            self.h["samples"].updateValue((i,), tuple(v))
        for t, v in self.templates.items():
            self.h["templates"].updateValue((t,), tuple(v))
        for t in self.changed:
            of = self.members[t]
            self.h["members"].updateValue((t,), (list(of), list(of.values())))
        for t in self.left if not self.fresh else ():
            self.h["templates"].removeKey((t,))
            self.h["members"].removeKey((t,))
        self.h["counters"].update((self.next, self.at))


class _Table(_State):
    """The state of one key of a finished table: nothing is saved, members are lists on disk. A further line of a sample is a row without a sample."""

    def __init__(self, handles):
        super().__init__(handles)
        self.list_of: dict[int, int] = {}

    def sample(self, i: int) -> list | None:
        return self.samples.get(i)

    def rows(self, t: int) -> Iterator[tuple]:
        return self.lists.rows(self.list_of.get(t, 0))

    def put(self, t: int, row: tuple) -> None:
        if t not in self.list_of:
            self.list_of[t] = self.lists.new()
        self.lists.add(self.list_of[t], row)

    def again(self, t: int, text: str) -> None:
        self.put(t, (self.line, None, text, 1))

    def gather(self, t: int, lists: Sequence[int]) -> None:
        lists = [*([self.list_of[t]] if t in self.list_of else []), *lists]
        if len(lists) > 1:
            whole = self.lists.new()
            for row in heapq.merge(*map(self.lists.rows, lists), key=itemgetter(0)):
                self.lists.add(whole, row)
            for k in lists:
                self.lists.drop(k)
            lists = [whole]
        self.list_of[t] = lists[0]

    def drop(self, template: int, into: int | None, reason: str) -> None:
        super().drop(template, into, reason)
        self.left.clear()
        self.lists.drop(self.list_of.pop(template, 0))


class Miner(StatefulProcessor):
    def __init__(self, merge: bool = True, split: bool = True, contained: bool = False, base: int = SPLIT_BASE, keep: bool = True):
        """keep: whether lines come after these, so that the state is to be kept; of a finished table all lines of a key come in one call."""
        self.merge, self.split, self.contained, self.base, self.keep = merge, split, contained, base, keep

    def init(self, handle) -> None:
        self.handles = {
            "counters": handle.getValueState("counters", "templates long, changes long"),
            "templates": handle.getMapState("templates", "template_id long", "text string, sample_limit long, lines long"),
            "samples": handle.getMapState("samples", "sample_id long", "template_id long, lines long, first_line long"),
            "members": handle.getMapState("members", "template_id long", "ids array<long>, texts array<string>"),
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = (_State if self.keep else _Table)(self.handles)
        try:
            for line, sample, text, later in _in_order(rows) if self.keep else (line for part in rows for line in _listed(part)):
                s.line = line
                for _ in self._message(s, sample, text, later):
                    yield self._table(key, s.log)
                    s.log.clear()
            if self.keep:
                s.save()
            yield self._table(key, s.log)
        finally:
            s.lists.close()

    @staticmethod
    def _table(key, log: list[tuple]) -> pd.DataFrame:
        found = dict(zip(_COLUMNS, zip(*log))) if log else dict.fromkeys(_COLUMNS, ())
        # whole numbers with nulls among them stay whole
        columns = {c: pd.array(list(v), "Int64") if c in _NUMBERS else pd.Series(v, dtype=object) for c, v in found.items()}
        return pd.DataFrame({f"key{k}": pd.Series([v] * len(log), dtype=object) for k, v in enumerate(key)} | columns)

    def _message(self, s: _State, sample: int, text: str, later: bool) -> Iterator[None]:
        """Yields where the log is to leave."""
        if (found := s.sample(sample)) is not None:
            found[1] += 1
            template = found[0]
            s.again(template, text)
            if not later:
                del s.samples[sample]
        else:
            template = self._search(s, text)
            reason = "matched"
            if template is None:
                template, reason = (yield from self._new(s, text)), "new"
            if later:
                s.samples[sample] = [template, 1, s.line]
            s.note("sample", reason, template, sample=sample)
            s.put(template, (s.line, sample, text, 1))
        s.templates[template][2] += 1
        if self.split and s.templates[template][2] >= s.templates[template][1]:
            yield from self._split(s, template)
        if len(s.log) >= LOGGED:
            yield

    @staticmethod
    def _search(s: _State, text: str) -> int | None:
        for t, (pattern, _, _) in s.templates.items():
            if matcher(pattern)(text):
                return t
        return next((t for t, (pattern, _, _) in s.templates.items() if EMPTY_GAP in pattern and matcher(pattern.replace(EMPTY_GAP, ""))(text)), None)

    def _new(self, s: _State, text: str) -> Generator[None, None, int]:
        limit, reason = self.base, "new"
        if self.merge and len(_WORDS.findall(text)) > 1:
            near = [(t, n) for t, n, _ in s.templates.values() if _near(t, text)]
            near.append((text, limit))
            cluster = [near[k] for k in cluster_of_last([t for t, _ in near])] if len(near) > 1 else near
            if len(cluster) > 1 and has_letter(name := merged_text([t for t, _ in cluster])):
                text, limit, reason = name, min(n for _, n in cluster), "merged"
        return (yield from self._add(s, text, limit, reason))

    def _add(self, s: _State, text: str, limit: int, reason: str, but: int | None = None) -> Generator[None, None, int]:
        """The template of this text: a new one, or one there that is equal or covers it; those that it covers give it their samples."""
        text = collapsed(text)
        if self.contained:
            return s.insert(text, limit, reason)
        coverer, covered, new = None, [], matcher(text) if WILDCARD in text else None
        for t, (pattern, _, _) in s.templates.items():
            if t == but:
                continue
            if pattern == text:
                return t
            if WILDCARD in pattern and matcher(pattern)(text):
                coverer = t
            elif new is not None and new(pattern):
                covered.append(t)
        to = s.insert(text, limit, reason) if coverer is None else coverer
        lists = []
        for t in covered:
            lists.append((yield from s.move(s.rows(t), t, to, "absorbed")))
            s.drop(t, to, "absorbed")
        if covered:
            s.gather(to, lists)
        return to

    def _split(self, s: _State, template: int) -> Iterator[None]:
        text, _, lines = s.templates[template]
        found = branch_names(lambda: (row[2] for row in s.rows(template) if row[1] is not None), round(math.log(lines, self.base)))
        if found is None or len(found[0]) == 1:
            s.templates[template][1] = 2 * lines
            s.note("template", "limit", template, text, 2 * lines)
            return
        parts = {name: [s.lists.new(), 0] for name in found[0]}
        for row in s.rows(template):
            part = parts[found[1](row[2])]
            s.lists.add(part[0], row)
            part[1] += row[3]
        for name, (part, weight) in parts.items():
            to = yield from self._add(s, name, 2 * weight, "split", but=template)
            moved = yield from s.move(s.lists.rows(part), template, to, "split")
            s.lists.drop(part)
            s.gather(to, [moved])
        s.drop(template, None, "split")

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, str, bool]]:
    """Lines by their number, and whether their text comes again. Batches that come in order, as those of a sorted table do, are passed on one by one; else they are sorted together."""
    last, held = None, []
    for part in rows:
        part = part[["line_no", "sample_id", "content", "later"]]
        if not held and part["line_no"].is_monotonic_increasing and (last is None or not len(part) or part["line_no"].iloc[0] > last):
            last = part["line_no"].iloc[-1] if len(part) else last
            yield from _numbered(part)
        else:
            held.append(part)
    if held:
        whole = pd.concat(held)
        if last is not None and whole["line_no"].min() <= last:
            raise ValueError("lines of one key must come in their order")
        yield from _numbered(whole)


def _numbered(part: pd.DataFrame) -> Iterator[tuple[int, int, str, bool]]:
    return _listed(part.sort_values(["line_no", "content"], kind="stable"))


def _listed(part: pd.DataFrame) -> Iterator[tuple[int, int, str, bool]]:
    return zip(part["line_no"].tolist(), part["sample_id"].tolist(), part["content"].tolist(), part["later"].tolist())


def mine_online(lines: DataFrame, key: Sequence[str] = ("dataset",), **options) -> DataFrame:
    """The log of changes (key, LOG) of lines(key, line_no, content), content being preprocessed; a stream or a table.

    options: merge, split, contained and base, as for mining.mine. A stream needs the state store that holds several kinds of state
    (``state_store``) and output mode append.
    """
    key = list(key)
    rows = lines.where("content is not null").select(*key, F.col("line_no").cast("long").alias("line_no"), F.xxhash64(*key, "content").alias("sample_id"), "content")
    spark = lines.sparkSession
    state_store(spark)
    if not rows.isStreaming:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # sorted twice where they are: by text, for what comes again, and by line
        after = Window.partitionBy(*key, "sample_id").orderBy("line_no")
        rows = rows.repartition(n, *key).withColumn("later", F.lead("line_no").over(after).isNotNull()).sortWithinPartitions(*key, "line_no", "content", F.desc("later"))
    else:
        rows = rows.withColumn("later", F.lit(True))
    schema = ", ".join(f"key{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(key)) + ", " + LOG
    out = rows.groupBy(*key).transformWithStateInPandas(Miner(**options, keep=rows.isStreaming), schema, "append", "none")
    return out.withColumnsRenamed({f"key{k}": c for k, c in enumerate(key)})


def state_store(spark) -> None:
    """The session keeps state in RocksDB, which this operator needs, and state of finished tables has a coordinator."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shared_dir(spark)
    _ = spark.streams.active


def templates_now(log: DataFrame, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """(key, template_id, template_text, sample_limit, ord) of the templates that are left: the last change of each, if it isn't that it went."""
    last = log.where("kind in ('template', 'gone')").groupBy(*key, "template_id").agg(F.max_by(F.struct("kind", "template_text", "sample_limit"), "at").alias("last"))
    return last.where("last.kind = 'template'").select(*key, "template_id", "last.template_text", "last.sample_limit", F.col("template_id").alias("ord"))


def samples_now(log: DataFrame, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """(key, sample_id, template_id): the last template of each sample."""
    return log.where("kind = 'sample'").groupBy(*key, "sample_id").agg(F.max_by("template_id", "at").alias("template_id"))


def events_now(log: DataFrame, key: Sequence[str] = ("dataset",)) -> tuple[DataFrame, DataFrame]:
    """(samples(sample_id, template_id), templates(template_id, template_text)) as match.structured takes them; template_id is a hash of the key and the number of the template in it."""
    own = F.xxhash64(*key, "template_id").alias("template_id")
    return samples_now(log, key).select("sample_id", own), templates_now(log, key).select(own, "template_text")


def relabelled(log: DataFrame, since: int | None = None, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """(key, sample_id, from_id, template_id) of samples that moved after line ``since``: whose lines need another event. from_id is null for samples that are new since then."""
    moved = log.where("kind = 'sample'") if since is None else log.where("kind = 'sample'").where(F.col("line_no") > since)
    ends = moved.groupBy(*key, "sample_id").agg(F.min_by(F.struct("from_id"), "at").alias("first"), F.max_by("template_id", "at").alias("template_id"))
    return ends.where("first.from_id is null or first.from_id <> template_id").select(*key, "sample_id", "first.from_id", "template_id")
