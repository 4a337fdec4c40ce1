"""Spellings of company and person names that mean one entity.

Names are cleaned of titles, departments and legal forms. Every name gives (head, tail) splits:
the distinctive word with the rest, and the whole name with an empty rest. Heads meet in a
pigeonhole segment join: a head within k edits of another shares at least one of k + 1 segments
with it, so segments are indexed and position-shifted substrings looked up; a banded edit distance
verifies. Tails then decide: equal, one typo apart, abbreviated, a nickname, an initial or left out.
Behind a head of many names only those tails are compared that share a key which one of these cases needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.folding import fold, loose, plain, within
from orderloom.session import cut_lineage, spread

# Legal forms, folded and without points, by code.
LEGAL_LINES = """
gmbh gmbh|mbh|gesellschaft mbh|gesellschaft mit beschrankter haftung
ag ag aktiengesellschaft
kg kg kommanditgesellschaft
ltd ltd limited
llc llc|limited liability company
plc plc|public limited company
inc inc incorporated
corp corp corporation
sarl sarl
srl srl|societa a responsabilita limitata
spa spa|societa per azioni
sa sa|societe anonyme|sociedad anonima
sl sl|soc ltda|ltda|sociedad limitada
bv bv|besloten vennootschap
nv nv
spzoo sp z oo|spz oo|sp z o o|spzoo|sp zoo|sp zo o|spolka z oo|spolka z o o
"""
LEGAL_WORDS: dict[str, str] = {}
for _line in LEGAL_LINES.strip().splitlines():
    _code, _rest = _line.split(" ", 1)
    for _part in _rest.split("|"):
        for _word in [_part] if "|" in _rest or _code == "spzoo" else _part.split():
            LEGAL_WORDS[_word] = _code

TITLES = frozenset("mr mrs ms miss dr prof herr frau sr sra senor senora mme mlle pan pani ing dipl messrs firma fa ms m/s".split())
COMPANY_TITLES = frozenset("messrs firma fa m/s".split())
DEPARTMENT = re.compile(
    r"\s*(?:\(\s*(?:head office|hq|zentrale|purchasing|accounts|einkauf)\s*\)|[-–/|,]\s+(?:accounts(?: payable)?|purchasing(?: dept\.?| department)?|procurement|einkauf|compras|achats|head office|sales|logistics)\.?)\s*$")

# Nicknames by given name.
NICKNAME_LINES = """
william bill billy will willy
robert bob bobby rob robby
margaret maggie peggy meg greta
edward ed eddie ned ted teddy
elizabeth liz lizzy beth betty eliza
nicholas nick nicky nico nicolas
michael mike mick micky michi
thomas tom tommy
katharina kathi katja kate kathy
friedrich fritz fredi friedel
patricia pat patty trish tricia
alexander alex sasha xander
oliver ollie olli
johannes hannes hans johann jo
guillermo guille memo willi
francisco paco fran pancho curro
giuseppe pino beppe peppe peppino
krzysztof krzysiek krzys chris
magdalena magda lena leni
susanne susi sanne susan
christine tina chris chrissy christy
valentina vale tina val
jonathan jon jonny johnny
daniel dan danny dani
"""
NICKNAMES: dict[str, frozenset[str]] = {}
for _line in NICKNAME_LINES.strip().splitlines():
    _given, *_nicks = _line.split()
    for _nick in _nicks:
        NICKNAMES[_nick] = NICKNAMES.get(_nick, frozenset()) | {_given}

#: Edits allowed between heads, and the length from which they are.
EDITS, FUZZY_FROM = 1, 5
#: Names behind a head up to which they are compared each with each; behind more, tails meet by their keys.
#: Either way finds the same pairs, so the number only decides how they are found.
SHARED_HEAD = 8
#: Letters from rare to frequent; others count as rarest.
RARE_LETTERS = "jqxzwykvfpbghmcudlotnrsiae"


def clean(name: str) -> tuple[str, str, bool]:
    """Words of a name (folded, one blank between), code of its legal form, and whether it is surely a company."""
    text = re.sub(r"\s+", " ", fold(name)).strip()
    text = DEPARTMENT.sub("", text)
    text = re.sub(r"&\s*co\b\.?|\bund co\b\.?|\+\s*co\b\.?", " & ", text)
    company = "&" in text
    if re.fullmatch(r"[^\W\d_]{2,}\.[^\W\d_]{3,}", text):
        text = text.replace(".", " ")
    raw = [w for w in re.split(r"[\s,()&;:-]+", text) if w]
    words = [w.replace(".", "") for w in raw]
    words = [w for w in words if w]
    while len(words) > 1 and (words[0] in TITLES):
        company = company or words[0] in COMPANY_TITLES
        words = words[1:]
    legal = ""
    for size in (4, 3, 2, 1):
        tail = " ".join(words[-size:])
        if len(words) > size and tail in LEGAL_WORDS:
            legal, words = LEGAL_WORDS[tail], words[:-size]
            break
    if sum(len(w) > 1 for w in words) > 1:
        singles = [w for w in words if len(w) == 1]
        if singles and len(words) - len(singles) >= 2:
            words = [w for w in words if len(w) > 1]
    return " ".join(plain(w) for w in words), legal, company or bool(legal)


def splits(form: str) -> list[tuple[str, str, bool]]:
    """(head, tail, whole) of a cleaned name; whole marks the head that is all of the name."""
    words = form.split()
    long = [w for w in words if len(w) > 1]
    if len(words) == 1:
        return _with_lookalikes([(form, "", True)])
    # with an initial the joined letters would look like a typo of the other word
    out = [("".join(words), "", True)] if len(long) == len(words) else []
    if len(words) == 2 and len(long) == 2:
        out.append((words[1] + words[0], "", True))
    for size in (1, 2):
        if len(words) > size:
            for head, tail in ((words[:size], words[size:]), (words[-size:], words[:-size])):
                if all(len(w) > 1 for w in head):
                    out.append(("".join(head), "".join(tail), False))
    return _with_lookalikes(out)


def _with_lookalikes(parts: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Each split also with its head in loose letters, without repeats."""
    return list(dict.fromkeys([*parts, *((loose(h), t, w) for h, t, w in parts)]))


def segments(text: str, k: int) -> list[str]:
    """Keys of the k + 1 even segments of an indexed string."""
    n, parts = len(text), k + 1
    bounds = [n * i // parts for i in range(parts + 1)]
    return [f"{n}:{i}:{text[bounds[i] : bounds[i + 1]]}" for i in range(parts)]


def probes(text: str, k: int) -> list[str]:
    """Keys of all substrings that may equal a segment of a string within k edits (swaps included)."""
    out, n, parts = set(), len(text), k + 1
    for m in range(max(1, n - k), n + k + 1):
        bounds = [m * i // parts for i in range(parts + 1)]
        for i in range(parts):
            size = bounds[i + 1] - bounds[i]
            for shift in range(-k, k + 1):
                start = bounds[i] + shift
                if 0 <= start and start + size <= n:
                    out.add(f"{m}:{i}:{text[start : start + size]}")
        if m == n:
            # one swap across a border harms two segments: look the string up as it was before
            for b in bounds[1:-1]:
                if 0 < b < n:
                    swapped = text[: b - 1] + text[b] + text[b - 1] + text[b + 1 :]
                    out.update(f"{m}:{i}:{swapped[bounds[i] : bounds[i + 1]]}" for i in range(parts))
    return sorted(out)


def abbreviates(short: str, long: str, company: bool) -> bool:
    """Whether one tail abbreviates another: letters left out (companies) or cut off (people)."""
    if len(short) < 3 or len(short) >= len(long) or short[0] != long[0]:
        return False
    if not company:
        return long.startswith(short)
    it = iter(long)
    return all(c in it for c in short) or (len(short) <= 5 and short[:3] == long[:3])


def tails_agree(a: str, b: str, company: bool) -> int:
    """2 if the tails mean the same, 1 if they may as ``a`` is left out, an initial or a nickname of several, else 0."""
    if a == b:
        return 2
    if not a or not b:
        return int(not a)
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return int(short == a and long[0] == short and not company)
    if len(short) >= 4 and (within(a, b, EDITS) or loose(a) == loose(b)):
        return 2
    for x, y in ((a, b), (b, a)):
        given = NICKNAMES.get(x, frozenset())
        if any(g == y or (len(y) > 4 and within(g, y, 1)) for g in given):
            return 2 if len(given) == 1 else int(x == a)
        if x == a and given & NICKNAMES.get(y, frozenset()):
            return 1 if len(given) > 1 or len(NICKNAMES[y]) > 1 else 2
    return 2 if abbreviates(short, long, company) else 0


def given_names(tail: str) -> set[str]:
    """Keys of the given names that a tail is a nickname of, or is, by at most one typo."""
    near = {g for given in NICKNAMES.values() for g in given if g == tail or (len(tail) > 4 and within(g, tail, 1))}
    return {f"n{g}" for g in near | NICKNAMES.get(tail, frozenset())}


def tail_keys(tail: str) -> list[str]:
    """Keys of a tail that is left out, an initial or the shorter of two: see ``tail_probes``."""
    if not tail:
        return ["=", "*"]
    out = {f"={tail}"} | given_names(tail)
    if len(tail) == 1:
        out.add(f"^{tail}")
    if len(tail) >= 3:
        # an abbreviation keeps the first letter and its two rarest others in their order, or the first three letters
        rest = sorted(sorted(range(1, len(tail)), key=lambda i: RARE_LETTERS.find(tail[i]))[:2])
        out |= {f"<{tail[0]}{tail[rest[0]]}{tail[rest[1]]}", f"p{tail[:3]}"}
    if len(tail) >= 4:
        out |= {f"~{loose(tail)}", *segments(tail, EDITS)}
    return sorted(out)


def tail_probes(tail: str) -> list[str]:
    """Keys that meet those of each tail which may agree with this one: of two tails that agree at least one finds the other."""
    if not tail:
        return ["="]
    out = {f"={tail}", "*"} | given_names(tail)
    if len(tail) > 1:
        out.add(f"^{tail[0]}")
    if len(tail) >= 4:
        out |= {f"~{loose(tail)}", f"p{tail[:3]}", *probes(tail, EDITS)}
        later: set[str] = set()
        follow: dict[str, set[str]] = {}
        for c in reversed(tail[1:]):
            # what follows the first of equal letters holds what follows the others
            follow[c] = set(later)
            later.add(c)
        out |= {f"<{tail[0]}{x}{y}" for x, ys in follow.items() for y in ys}
    return sorted(out)


def _keys(make) -> object:
    """Array column of the keys that a function makes of a string."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([make(v) for v in values], dtype=object)

    return F.pandas_udf(run, "array<string>")


def crowded_pairs(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """part_a, part_b (``part`` of two rows) behind heads of many names whose tails may agree, in both directions.

    Work follows the keys of the tails, not the square of the names behind a head.
    """
    # few bytes, much work: keys are made of the crowded rows only, in all tasks
    index = spread(pairs.select(F.col("h").alias("head"), "pair").join(parts.select("head", "tail", "part"), "head"), "part")
    probe = spread(pairs.select(F.col("g").alias("head"), "pair").join(parts.select("head", "tail", "part"), "head"), "part")
    index = index.select("pair", F.col("part").alias("part_a"), F.explode(_keys(tail_keys)("tail")).alias("key"))
    probe = probe.select("pair", F.col("part").alias("part_b"), F.explode(_keys(tail_probes)("tail")).alias("key"))
    met = index.join(probe, ["pair", "key"]).where("part_a <> part_b").select("part_a", "part_b").distinct()
    return met.unionByName(met.select(F.col("part_b").alias("part_a"), F.col("part_a").alias("part_b"))).distinct()


def head_pairs(heads: DataFrame, k: int = EDITS) -> DataFrame:
    """Pigeonhole segment join of distinct strings: h, g within k edits, both directions and itself."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, k) for x, y in zip(a, b, strict=True)])

    fuzzy = heads.where(F.length("head") >= FUZZY_FROM)
    index = fuzzy.select(F.col("head").alias("h"), F.explode(_keys(lambda v: segments(v, k))("head")).alias("key"))
    probe = fuzzy.select(F.col("head").alias("g"), F.explode(_keys(lambda v: probes(v, k))("head")).alias("key"))
    met = index.join(probe, "key").where((F.col("h") < F.col("g")) & (F.levenshtein("h", "g", 2 * k) >= 0)).select("h", "g").distinct()
    found = cut_lineage(met.where(near("h", "g")))
    same = heads.select(F.col("head").alias("h"), F.col("head").alias("g"))
    return same.unionByName(found).unionByName(found.select(F.col("g").alias("h"), F.col("h").alias("g")))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of each node: the heaviest node that it is connected to (weight, then name).

    ``nodes`` has node and weight, ``links`` a and b, nodes of it, in either order. Each round every root
    points to its heaviest neighbour, pointers are followed to their ends, and links are carried over to
    the ends, until none is left between two roots; each round leaves at most half of the linked roots.
    """
    rooted = nodes.select("node", F.struct("weight", "node").alias("root"))
    ends = rooted.select(F.col("node").alias("a"), F.col("root").alias("x")), rooted.select(F.col("node").alias("b"), F.col("root").alias("y"))
    links = links.join(ends[0], "a").join(ends[1], "b").where("x <> y").select("x", "y")
    links = cut_lineage(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    while not links.isEmpty():
        up = cut_lineage(links.groupBy("x").agg(F.max("y").alias("to")).where("to > x"))
        while True:
            ahead = up.select(F.col("x").alias("to"), F.col("to").alias("end"))
            if up.join(ahead, "to").isEmpty():
                break
            up = cut_lineage(up.join(ahead, "to", "left").select("x", F.coalesce("end", "to").alias("to")))
        rooted = cut_lineage(rooted.join(up.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end in ("x", "y"):
            moved = up.select(F.col("x").alias(end), F.col("to").alias("end"))
            links = links.join(moved, end, "left").withColumn(end, F.coalesce("end", end)).drop("end")
        links = cut_lineage(links.where("x <> y").distinct())
    return rooted.select("node", F.col("root.node").alias("root"))


def name_classes(values: DataFrame) -> DataFrame:
    """name and class_id for each distinct name of ``values`` (one column ``name``, rows may repeat).

    NULL and blank names stay out, as do names without a letter. A name whose rest is missing, an
    initial or an ambiguous nickname joins a class only if just one fits it, by legal form if need be,
    and takes along the names that surely mean the same as it. Names that surely mean the same are one
    class, over any number of steps, except lone words of different legal forms: these part where more
    than one class fits the word.
    """

    def clean_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for names in batches:
            yield pd.DataFrame([clean(n) for n in names], columns=["form", "legal", "company"])

    def split_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for forms in batches:
            yield pd.Series([[{"head": h, "tail": t, "whole": w} for h, t, w in splits(f)] for f in forms], dtype=object)

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series, company: pd.Series) -> pd.Series:
        return pd.Series([tails_agree(x, y, c) for x, y, c in zip(a, b, company, strict=True)])

    counted = values.where("name is not null").groupBy("name").count()
    # else the filter on the form is pushed below the counting, and all rows are cleaned, not the distinct names
    cleaner = F.pandas_udf(clean_batches, "struct<form:string,legal:string,company:boolean>").asNondeterministic()
    cleaned = counted.withColumn("c", cleaner("name"))
    members = cleaned.select("name", "count", "c.*").where("form <> ''")
    # a lone word says little: there the legal form is part of the identity
    members = members.withColumn("node", F.when(F.instr("form", " ") == 0, F.concat_ws("|", "form", "legal")).otherwise(F.col("form")))
    # written once: each is read several times below, and the plan would repeat all of its making
    members = cut_lineage(members)
    nodes = members.groupBy("node").agg(F.first("form").alias("form"), F.sum("count").alias("weight"), F.max("company").alias("company"), F.collect_set("legal").alias("legals"))
    parts = nodes.withColumn("s", F.explode(F.pandas_udf(split_batches, "array<struct<head:string,tail:string,whole:boolean>>")("form")))
    parts = cut_lineage(parts.select("node", "weight", "company", "legals", "s.*", F.monotonically_increasing_id().alias("part")))
    shared = parts.groupBy("head").agg(F.count("*").alias("sharing"))
    pairs = head_pairs(parts.select("head").distinct())
    pairs = pairs.join(shared.select(F.col("head").alias("h"), F.col("sharing").alias("sharing_h")), "h").join(shared.select(F.col("head").alias("g"), F.col("sharing").alias("sharing_g")), "g")
    crowded = F.least("sharing_h", "sharing_g") > SHARED_HEAD
    pairs = cut_lineage(pairs.select("h", "g", crowded.alias("crowded"), F.monotonically_increasing_id().alias("pair")))
    a = parts.select(F.col("head").alias("h"), F.col("part").alias("part_a"), F.col("node").alias("node_a"), F.col("tail").alias("tail_a"), F.col("company").alias("company_a"), F.col("legals").alias("legals_a"))
    b = parts.select(F.col("head").alias("g"), F.col("part").alias("part_b"), F.col("node").alias("node_b"), F.col("tail").alias("tail_b"), F.col("company").alias("company_b"), F.col("legals").alias("legals_b"))
    met = a.join(pairs.where("not crowded").select("h", "g"), "h").join(b, "g")
    keyed = a.join(crowded_pairs(parts, pairs.where("crowded")), "part_a").join(b, "part_b")
    met = met.unionByName(keyed).where("node_a <> node_b")
    # else each pair is compared twice, once for the filter
    agree = agree.asNondeterministic()
    edges = met.withColumn("sure", agree("tail_a", "tail_b", F.col("company_a") | F.col("company_b"))).where("sure > 0")
    edges = edges.withColumn("legal_fits", F.arrays_overlap("legals_a", "legals_b"))
    edges = edges.groupBy("node_a", "node_b").agg(F.max("sure").alias("sure"), F.max("legal_fits").alias("legal_fits"))
    edges = cut_lineage(edges)
    # the legal form of a lone word is part of the identity, so another one leaves the link open until the end
    sister = F.expr("instr(node_a, ' ') = 0 and instr(node_b, ' ') = 0 and not legal_fits")
    weak, sisters = edges.where("sure = 1"), edges.where("sure = 2").where(sister)
    own = nodes.select("node", "weight")
    rooted = components(own, edges.where("sure = 2").where(~sister).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))

    def between(links: DataFrame) -> DataFrame:
        """Links with the roots of their ends as a and b, where these differ."""
        ends = (rooted.toDF(f"node_{x}", x, f"placed_{x}") for x in "ab")
        return links.join(next(ends), "node_a").join(next(ends), "node_b").where("a <> b").select("a", "b", "legal_fits")

    def merged(links: DataFrame) -> DataFrame:
        """Nodes with their roots after links between roots a and b."""
        joined = components(own, links.select("a", "b")).toDF("root", "top")
        return cut_lineage(rooted.join(joined, "root").select("node", F.col("top").alias("root"), "placed"))

    rooted = rooted.withColumn("placed", F.lit(False))
    # a class that joins another may leave just one to a third: until no class finds a place
    while True:
        unplaced = rooted.where("not placed").select(F.col("node").alias("node_a"))
        reach = between(weak.join(unplaced, "node_a")).groupBy("a").agg(F.collect_set("b").alias("all"), F.collect_set(F.when(F.col("legal_fits"), F.col("b"))).alias("fitting"))
        only = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("fitting") == 1, F.col("fitting")[0])
        reach = cut_lineage(reach.select("a", only.alias("b")))
        adopted = reach.where("b is not null")
        if adopted.isEmpty():
            break
        rooted = rooted.join(adopted.select(F.col("a").alias("root"), F.lit(True).alias("now")), "root", "left").select("node", "root", F.expr("placed or now is not null").alias("placed"))
        rooted = merged(adopted)
    # lone words of other legal forms: those without a place go together, and to a class if it is the only one
    several = rooted.join(reach.select(F.col("a").alias("root"), F.lit(True).alias("several")), "root", "left")
    kinds = cut_lineage(several.select("node", F.expr("case when placed then 'placed' when several then 'several' else 'free' end").alias("kind")))
    sisters = sisters.join(kinds.toDF("node_a", "kind_a"), "node_a").join(kinds.toDF("node_b", "kind_b"), "node_b")
    rooted = merged(between(sisters.where("kind_a = kind_b and kind_a <> 'placed'")))
    free = between(sisters.where("kind_a = 'free' and kind_b <> 'free'")).groupBy("a").agg(F.collect_set("b").alias("all"))
    final = merged(free.where("size(all) = 1").select("a", F.col("all")[0].alias("b")))
    return members.join(final, "node").select("name", F.xxhash64("root").alias("class_id"))


def name_groups(orders: DataFrame, fields: tuple[str, ...] = ("supplier_name", "buyer_name")) -> DataFrame:
    """name, class_id, spellings of each stored name."""
    members = name_classes(orders.select(F.explode(F.array(*fields)).alias("name")))
    return members.join(members.groupBy("class_id").agg(F.count("*").alias("spellings")), "class_id").select("name", "class_id", "spellings")


def name_pairs(orders: DataFrame, fields: tuple[str, ...] = ("supplier_name", "buyer_name")) -> DataFrame:
    """name_a, name_b of all pairs of different stored names of one entity, the smaller first."""
    members = name_classes(orders.select(F.explode(F.array(*fields)).alias("name")))
    left, right = members.withColumnRenamed("name", "name_a"), members.withColumnRenamed("name", "name_b")
    return left.join(right, "class_id").where("name_a < name_b").select("name_a", "name_b")
