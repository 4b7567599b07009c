"""Main bodies of saved web pages (problem 4): wrapper induction.

A chunk of a saved page is a fragment of the page's tree: blocks of one kind (menu, list, table, heading, text) and their lines; the first
segments of lines of segments (menus, breadcrumbs) form a block of their own. Each fragment is aligned by simple tree matching with ``PEERS``
fragments of the same section of its host (``source_id``), and with as many of other sections of the same host, all in an order that spreads
sections and hosts evenly over partitions. Nodes that match letter for letter, numbers aside, are constant nodes: their matches are summed over
all fragments, and a constant node becomes template if it stands in enough fragments of its section, or in enough sections of its host. A
node that no alignment matches is never template, however often it stands.

Varying slots are template where their place says so: the rest of a breadcrumb behind a constant first segment, and the link lines below a
constant node; all other varying slots are content. A menu is template too if all its segments are segments of constant menus of many sections.

All counts cover all pages; no section or host is gathered in one task.

Defined results: null urls belong to no page; null and blank lines are never reported; a chunk given twice counts once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import broadcast_if_small, cut

PEERS = 8
#: Alignments of one pair of trees, each of what the one before left: nodes that change places match in a later one.
ROUNDS = 3
#: A constant node of a section stands in at least so many of its fragments (list items and headings, which content repeats by chance, in one
#: more) and this share of them; one of a host in at least so many sections and this share of them.
LEAST = 2
SHARE = 0.015
LEAST_SECTIONS = 3
SECTIONS_SHARE = 0.02
#: Share of a section's fragments that a constant first segment of breadcrumbs stands in.
CRUMB_SHARE = 0.05

MENU, ROW, HEADING, ITEM, LINK, CRUMB, TEXT = range(7)
SEPARATOR = re.compile(r"\s+[|•·/»›>]\s+")
WHOLE_LINK = re.compile(r"^\W*\[[^\]]+\]\(\S+?\)+\W*$")
# A title and the name of a page: "Title | 12345", "> Title - IS-12345", "Title (IS-12345-(Part-2))".
NAMED_LINK = re.compile(r"^(?:[>*-]\s*)?[^.?!:|]+?(?:\s[|–-]\s|\s\()(?:[A-Z]{1,6}-)?\d{2,}(?::\d{4})?(?:-\(\S+\))?\)?\s*$")


def address(url: Column) -> Column:
    """An url without scheme, leading www., query, fragment and final slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)^www\.", ""), "/+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(address(url), "^[^/]*", 0))


def page_chunks(chunks: DataFrame, downloads: DataFrame, folder: str = "data/raw/html/") -> DataFrame:
    """(chunk_id, source_id, host, text): the chunks whose url is the address of a saved web page."""
    saved = downloads.where(F.col("path").startswith(folder)).select(address(F.col("url")).alias("address")).where("address != ''").distinct()
    rows = chunks.where("chunk_id is not null and text is not null and url is not null")
    rows = rows.select("chunk_id", "source_id", "text", host(F.col("url")).alias("host"), address(F.col("url")).alias("address"))
    return rows.join(broadcast_if_small(cut(saved)), "address", "left_semi").drop("address")


def kind_of(line: str) -> int:
    s = line.strip()
    if s.startswith("|") and s.endswith("|") and s.count("|") > 2:
        return ROW
    if WHOLE_LINK.match(s) or NAMED_LINK.match(s):
        return LINK
    if s.startswith("#"):
        return HEADING
    if len(SEPARATOR.findall(s)) >= 2:
        return MENU
    return ITEM if s[:2] in ("- ", "* ") else TEXT


def signature(text: str) -> int | None:
    """Of the letters and digits in lower case, each run of digits as one; null if there is no letter."""
    s = re.sub(r"[\d]+", "#", "".join(c for c in text.lower() if c.isalnum()))
    return xxhash.xxh64_intdigest(s) >> 1 if s.strip("#") else None


def trees(pages: DataFrame) -> DataFrame:
    """(chunk_id, source_id, host, line_no, kind, sig, segments): of each fragment its lines that are not blank; segments of menus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int | None] = {}

        def sig(s: str) -> int | None:
            if len(s) > 200:
                return signature(s)
            if s not in known:
                if len(known) > 200_000:
                    known.clear()
                known[s] = signature(s)
            return known[s]

        for pdf in batches:
            out = []
            for cid, sid, h, text in pdf[["chunk_id", "source_id", "host", "text"]].itertuples(index=False):
                no, kinds, sigs, segs = [], [], [], []
                for k, line in enumerate(text.split("\n"), 1):
                    if line.strip(" \t\r​﻿　 "):
                        kind = kind_of(line)
                        no.append(k)
                        kinds.append(kind)
                        sigs.append(sig(line))
                        segs.append([x for s in SEPARATOR.split(line) if (x := sig(s)) is not None] if kind == MENU else [])
                out.append((cid, sid, h, no, kinds, sigs, segs))
            yield pd.DataFrame(out, columns=["chunk_id", "source_id", "host", "line_no", "kind", "sig", "segments"])

    schema = "chunk_id string, source_id string, host string, line_no array<int>, kind array<int>, sig array<long>, segments array<array<long>>"
    return pages.select("chunk_id", "source_id", "host", "text").mapInPandas(run, schema)


#: A tree: of each node, by kind and signature, its block and its place in the fragment where it first stands.
Tree = dict[tuple[int, int], tuple[int, int]]


def tree_of(kinds: list[int], sigs: list[int | None], firsts: list[int | None] = ()) -> Tree:
    """Runs of lines of one kind are blocks; ``firsts`` are the first segments of the lines that have some, a block before the others."""
    out: Tree = {}
    for at, x in enumerate(firsts):
        if x is not None:
            out.setdefault((CRUMB, x), (0, at))
    block, before = 0, None
    for at, (k, x) in enumerate(zip(kinds, sigs, strict=True)):
        if k != before:
            block, before = block + 1, k
        if x is not None:
            out.setdefault((k, x), (block, at))
    return out


def _rising(places: list[tuple[int, int]]) -> list[int]:
    """Indexes of a longest run of pairs, given in order of the first member, in which the second rises."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for k, (_, q) in enumerate(places):
        i = bisect_left(ends, q)
        if i == len(ends):
            ends.append(q)
            at.append(k)
        else:
            ends[i], at[i] = q, k
        back[k] = at[i - 1] if i else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: the nodes matched by the order-keeping pairing of the blocks with the most matched nodes."""
    if len(a) > len(b):
        common = [n for n in b if n in a]
    else:
        common = [n for n in a if n in b]
    if not common:
        return []
    pairs: dict[tuple[int, int], list[tuple[int, int, tuple[int, int]]]] = {}
    for n in common:
        (i, p), (j, q) = a[n], b[n]
        pairs.setdefault((i, j), []).append((p, q, n))
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ij, nodes in pairs.items():
        nodes.sort()
        chosen[ij] = [nodes[k][2] for k in _rising([(p, q) for p, q, _ in nodes])] if len(nodes) > 1 else [nodes[0][2]]
    # The heaviest chain of block pairs rising in both; a Fenwick tree holds the best chain that ends up to a block of b.
    keys = sorted(chosen, key=lambda ij: (ij[0], -ij[1]))
    last = max(j for _, j in keys) + 1
    best: list[tuple[int, tuple[int, int] | None]] = [(0, None)] * (last + 1)
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    top: tuple[int, tuple[int, int] | None] = (0, None)
    for ij in keys:
        j, before = ij[1], (0, None)
        while j > 0:
            if best[j][0] > before[0]:
                before = best[j]
            j -= j & -j
        here = (before[0] + 1 + len(chosen[ij]), ij)
        back[ij] = before[1]
        if here[0] > top[0]:
            top = here
        j = ij[1] + 1
        while j <= last:
            if here[0] > best[j][0]:
                best[j] = here
            j += j & -j
    out: list[tuple[int, int]] = []
    at = top[1]
    while at is not None:
        out += chosen[at]
        at = back[at]
    return out


def matched(a: Tree, b: Tree, rounds: int = ROUNDS) -> set[tuple[int, int]]:
    """The nodes that match in up to ``rounds`` alignments, each of what the one before left."""
    out: set[tuple[int, int]] = set()
    for _ in range(rounds):
        found = aligned(a, b)
        out.update(found)
        if not found or sum(n in b for n in a) == len(found):
            break
        gone = set(found)
        a, b = ({n: p for n, p in t.items() if n not in gone} for t in (a, b))
    return out


def votes(nodes: DataFrame, key: str, peers: int = PEERS, across: bool = False) -> DataFrame:
    """(<key>, crumb, sig, seen, matches, items): in how many fragments of a section or host a node stands, how often it matched in an
    alignment, and in how many fragments it is a list item or a heading. crumb: whether it is a first segment.

    With ``across`` only fragments of different sections are aligned.
    """
    columns = [key, "crumb", "sig", "seen", "matches", "items"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        hits: Counter = Counter()
        items: Counter = Counter()
        before: list[tuple[str | None, str | None, Tree]] = []

        def out() -> pd.DataFrame:
            rows = [(s, c, x, n, hits[s, c, x], items[s, c, x]) for (s, c, x), n in seen.items()]
            for counts in (seen, hits, items):
                counts.clear()
            return pd.DataFrame(rows, columns=columns)

        for pdf in batches:
            for of, sid, kinds, sigs, firsts in pdf[["key", "source_id", "kind", "sig", "firsts"]].itertuples(index=False):
                clean = lambda xs: [None if x is None or x != x else int(x) for x in xs]
                tree = tree_of(list(kinds), clean(sigs), clean(firsts))
                tree = {n: p for n, p in tree.items() if n[0] != ROW}
                nodes_of = {(of, k == CRUMB, x) for k, x in tree}
                seen.update(nodes_of)
                items.update({(of, False, x) for k, x in tree if k in (ITEM, HEADING)})
                before = [b for b in before if b[0] == of][-peers:] if peers else []
                for _, other_sid, other in before:
                    if not across or other_sid != sid:
                        hits.update({(of, k == CRUMB, x) for k, x in matched(tree, other)})
                before.append((of, sid, tree))
            if len(seen) > 300_000:
                yield out()
        yield out()

    first = F.transform(F.filter("segments", lambda s: F.size(s) > 0), lambda s: s[0])
    # A range by key and a hash keeps fragments of one key together but splits a large one over partitions.
    placed = nodes.select(F.col(key).alias("key"), "source_id", "kind", "sig", first.alias("firsts"), F.xxhash64("chunk_id").alias("h")).repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    part = placed.mapInPandas(run, f"`{key}` string, crumb boolean, sig long, seen long, matches long, items long")
    return part.groupBy(key, "crumb", "sig").agg(*(F.sum(c).alias(c) for c in ("seen", "matches", "items")))


def template(nodes: DataFrame, peers: int = PEERS) -> tuple[DataFrame, DataFrame]:
    """(source_id, crumb, sig) of the template nodes of each section, and (host, sections, crumb, sig) of those of each host."""
    size = nodes.groupBy("source_id").agg(F.count("*").alias("n"))
    own = cut(votes(nodes, "source_id", peers))
    counted = own.where(f"matches > 0 and seen >= if(items > 0, {LEAST + 1}, {LEAST})").join(size.withColumnRenamed("source_id", "s"), F.col("source_id").eqNullSafe(F.col("s")))
    local = counted.where(f"seen >= if(crumb, {CRUMB_SHARE}, {SHARE}) * n").select("source_id", "crumb", "sig")
    # In how many sections of the host a node stands that matched across sections.
    met = votes(nodes, "host", peers, across=True).where("matches > 0").select("host", "crumb", "sig")
    places = cut(nodes.select("host", "source_id").distinct())
    least = places.groupBy("host").agg(F.greatest(F.lit(LEAST_SECTIONS), F.ceil(SECTIONS_SHARE * F.count("*"))).alias("least"))
    standing = own.select("source_id", "crumb", "sig").join(places.withColumnRenamed("source_id", "s"), F.col("source_id").eqNullSafe(F.col("s")))
    wide = standing.groupBy("host", "crumb", "sig").agg(F.count("*").alias("sections")).join(met, ["host", "crumb", "sig"]).join(least, "host").where("sections >= least")
    return local, wide.select("host", "crumb", "sig")


def surroundings(chunks: DataFrame, downloads: DataFrame, peers: int = PEERS) -> DataFrame:
    """(chunk_id, line_no) of the lines of web-page chunks that are not main body. Without peers nothing is aligned, and only links at a
    fragment's beginning are left out."""
    nodes = cut(trees(page_chunks(chunks, downloads)).dropDuplicates(["chunk_id"]))
    local, wide = (cut(x) for x in template(nodes, peers))
    local, wide = broadcast_if_small(local.withColumnRenamed("sig", "g")), broadcast_if_small(wide.withColumnsRenamed({"sig": "g", "host": "w"}))
    lines = nodes.select("chunk_id", F.col("source_id").alias("s"), "host", F.explode(F.arrays_zip("line_no", "kind", "sig", "segments")).alias("x")).select("chunk_id", "s", "host", "x.*")

    def constant(df: DataFrame, crumb: bool, sig: str, name: str) -> DataFrame:
        """``df`` with ``name``: whether the node ``sig`` is template in its section or its host."""
        x = local.where(F.col("crumb") == crumb).select("source_id", "g", F.lit(True).alias("in_section"))
        y = wide.where(F.col("crumb") == crumb).select("w", F.col("g").alias("g2"), F.lit(True).alias("in_host"))
        out = df.join(x, df["s"].eqNullSafe(x["source_id"]) & (df[sig] == x["g"]), "left").drop("source_id", "g")
        out = out.join(y, (out["host"] == y["w"]) & (out[sig] == y["g2"]), "left").drop("w", "g2")
        return out.withColumn(name, F.coalesce("in_section", "in_host", F.lit(False))).drop("in_section", "in_host")

    lines = constant(lines.withColumn("first", F.try_element_at("segments", F.lit(1))), False, "sig", "whole")
    marked = cut(constant(lines, True, "first", "crumb"))
    # Segments of constant menus of many sections, and the menus all of whose segments are such.
    known = marked.where(f"kind = {MENU} and whole").select("s", F.explode("segments").alias("sig")).distinct().groupBy("sig").count().where(f"count >= {LEAST_SECTIONS}").select("sig", F.lit(True).alias("known"))
    menus = marked.where(f"kind = {MENU} and not whole and not crumb").select("chunk_id", "line_no", F.explode("segments").alias("sig"))
    menu = menus.join(broadcast_if_small(cut(known)), "sig", "left").groupBy("chunk_id", "line_no").agg(F.every(F.coalesce("known", F.lit(False))).alias("menu")).where("menu")
    lines = marked.join(broadcast_if_small(cut(menu)), ["chunk_id", "line_no"], "left").select(
        "chunk_id", "line_no", "kind", ((F.col("kind") != ROW) & (F.col("whole") | F.col("crumb") | F.coalesce("menu", F.lit(False)))).alias("template")
    )
    # Link lines continue the template if they follow a constant node, another such line, or the fragment's border.
    ordered = lines.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind", "template"))).alias("lines"))
    slots = F.expr(
        f"""aggregate(lines, named_struct('open', true, 'out', cast(array() as array<int>)), (acc, x) ->
        named_struct('open', x.template or (acc.open and x.kind = {LINK}),
                     'out', if(x.template or (acc.open and x.kind = {LINK}), concat(acc.out, array(x.line_no)), acc.out))).out"""
    )
    return ordered.select("chunk_id", F.explode(slots).alias("line_no"))


def main_bodies(chunks: DataFrame, downloads: DataFrame) -> DataFrame:
    """(chunk_id, source_id, text): the web-page chunks with only the main body of their text, each once."""
    gone = cut(surroundings(chunks, downloads).groupBy("chunk_id").agg(F.collect_list("line_no").alias("gone")))
    pages = once(page_chunks(chunks, downloads).select("chunk_id", "source_id", "text"), "chunk_id")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> gone is null or not array_contains(gone, i + 1)), '\\n')")
    return pages.join(broadcast_if_small(gone), "chunk_id", "left").select("chunk_id", "source_id", kept.alias("text"))


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each ``key``: repeated keys are found by a count of the keys alone, and only their rows are moved."""
    again = broadcast_if_small(cut(df.groupBy(key).count().where("count > 1").select(key)))
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))
