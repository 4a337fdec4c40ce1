"""Address strings that denote one location.

Each distinct string is parsed into house number, street, kind of street, postcode and town;
abbreviations are expanded by dictionaries of the locales and parts that do not matter (company,
addressee, dock, floor, country) are dropped. Parsed forms meet on hierarchical keys, number with
postcode first, number with street where a postcode is missing, and explicit rules decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.folding import fold, loose, within
from orderloom.llm.names import components, probes, segments
from orderloom.session import cut_lineage

# Kinds of street, folded. One code per line; words that may stand before or after a name.
KIND_LINES = """
str street st str straat strasse
rd road rd
ln lane ln laan la
dr drive dr drv
cl close cl calle c/ clo c
av avenue ave av avenida avda avd
bd boulevard blvd bd bld boul bvd
r rue r
ch chemin ch chem che
v via v
vle viale vle v.le
pza piazza p.zza p.za pza pzza pzz p.za.
po paseo po pº pso p.o
pl plac pl platz place plaza plein
al aleja al allee all
ul ulica ul
wg weg wg
ct court ct
sq square sq
ter terrace ter terr
crt corso c.so
lgo largo lgo
"""
KINDS = {word: line.split()[0] for line in KIND_LINES.strip().splitlines() for word in line.split()[1:]}
LONG_KINDS = {word: code for word, code in KINDS.items() if len(word) >= 5}
#: Kinds that only follow a name, and those that only precede one; the rest may do either.
FOLLOWING = frozenset("street st str road rd lane ln la drive dr drv close clo straat strasse laan weg wg court ct square sq terrace ter terr allee all platz plein".split())
PRECEDING = frozenset("via viale vle v.le piazza p.zza p.za pza pzza pzz p.za. calle c/ avenida avda avd paseo po pº pso p.o plac aleja ulica ul rue r chemin ch chem che v corso c.so largo lgo c".split())
#: Ends of one-word German and Dutch street names; the short ones need their point.
GLUED = re.compile(r"^(.{3,}?)-?(strasse|straat|platz|plein|allee|laan|weg|str\.?|wg\.|pl\.|al\.|ln\.|wg|ln)$")
GLUED_CODE = {"strasse": "str", "straat": "str", "str": "str", "platz": "pl", "plein": "pl", "pl": "pl", "allee": "al", "al": "al", "laan": "ln", "ln": "ln", "weg": "wg", "wg": "wg"}

# Words for countries and states, folded.
COUNTRIES = frozenset("""
germany deutschland de d usa us u.s.a u.s.a. u.s united states of america uk u.k. gb england scotland wales great britain kingdom france fr f italy italia it i spain espana es e
netherlands nederland nl the poland polska pl austria osterreich at a switzerland schweiz ch belgium belgie be portugal pt
""".split())  # fmt: skip
STATES = frozenset("""
al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy
""".split())  # fmt: skip
LEGAL = re.compile(
    r"\b(?:sp\.? ?z ?o\.? ?o\.?|g\.?m\.?b\.?h\.?(?: & co\.? kg)?|s\.?a\.?r\.?l\.?|s\.?r\.?l\.?|s\.?p\.?a\.?|s\.?a\.?|s\.?l\.?|b\.?v\.?|n\.?v\.?|p\.?l\.?c\.?|l\.?l\.?c\.?"
    r"|k\.?g\.?|a\.?g\.?|ltda?\.?|limited|incorporated|inc\.?|corporation|corp\.?|co\.|aktiengesellschaft)(?=$|[\s,;|])")  # fmt: skip
NOISE = re.compile(
    r"\b(?:attn\.?|attention|z\. ?hd\.?|c/o|care of|fao)\s*:?\s*(?:(?:goods in|receiving|wareneingang|accounts payable|einkauf|purchasing)\b|[^,;\n|]*?(?=[,;\n|]| - ))"
    r"|\b(?:accounts payable|goods in|receiving|wareneingang)\b"
    r"|\b(?:dock|gate|halle|hall|suite|ste|unit|bay|room|rm|apt|bldg|building|gebaude|hal|tor|rampe|lager|warehouse|dept)\.? ?(?:no\.? ?)?#? ?[a-z]?\d*\b(?=[\s,;|\n]|$)"
    r"|\b\d{1,2}(?:st|nd|rd|th|\.|o|e|er|eme)? (?:floor|fl|etage|og|stock|piano|planta|pietro|verdieping)\b|\b(?:floor|level|etage) \d{1,2}\b")  # fmt: skip
POSTCODE = re.compile(r"\b(?:([a-z]{1,2}\d{1,2}[a-z]?) ?(\d[a-z]{2})|(?:[a-z]{1,3}-)?(\d{5})(?:-\d{4})?|(\d{4}) ?([a-z]{2})|(\d{2}-\d{3}))\b")
HOUSE = re.compile(r"^(\d{1,5}[a-z]?(?:[-/]\d{1,4}[a-z]?)?)$")
NUMBER_SIGN = re.compile(r"(?:\b(?:nr|no|num|numero|n)\.|\bn°|\bnº|#|№|\bnr\b|\bno\b)\s*(?=\d)")
#: Pairs behind one key of number and street from which towns are looked up by their segments, and edits between towns.
CROWD, TOWN_EDITS = 10_000, 2


@lru_cache(maxsize=200_000)
def _kind(token: str, not_as: frozenset[str]) -> str | None:
    """Code of a kind word that may stand here; long words may have a typo."""
    bare = token.rstrip(".") if token not in KINDS else token
    if bare in KINDS:
        return None if bare in not_as else KINDS[bare]
    if len(bare) >= 5 and bare.isalpha():
        # one edit leaves the first two letters or the last two
        ends = bare[:2], bare[-2:]
        return next((code for word, code in LONG_KINDS.items() if (word[:2] == ends[0] or word[-2:] == ends[1]) and word not in not_as and within(bare, word, 1)), None)
    return None


def parse(address: str) -> tuple[str | None, ...]:
    """House number, street name, kind of street, postcode, town key and whole town of one string; None where missing."""
    text = fold(address).replace("\r", "\n")
    text = re.sub(r"[,;\n]| [-–] ", " | ", re.sub(NOISE, " ", text))
    text = NUMBER_SIGN.sub(" ", text)
    code = None
    found = list(POSTCODE.finditer(text))
    if found:
        m = _postcode(text, found)
        code = re.sub(r"^[a-z]{1,3}-|\s", "", m.group(0)) if m.group(3) else m.group(0).replace(" ", "")
        text = f"{text[: m.start()]} |@ {text[m.end() :]}"
    if m := LEGAL.search(text):
        start = text.rfind("|", 0, m.start())
        # without separators the company is what stands before its legal form
        text = f"{text[: start + 1]} | {text[m.end() :]}"
    tokens = text.split()
    number, name, kind, used = _street(tokens)
    rest: list[list[str]] = [[]]
    for i, t in enumerate(tokens):
        if t.startswith("|") or i in used:
            if rest[-1]:
                rest.append([])
            if t == "|@":
                rest[-1].append("@")
        else:
            rest[-1].append(t)
    return number, loose(name) if name else None, kind, code, *_town(rest)


def _postcode(text: str, found: list[re.Match[str]]) -> re.Match[str]:
    """The group that is the postcode: behind a state if one is; of several of five digits the last, as house numbers may have five too."""
    fives = [m for m in found if m.group(3)]
    behind = [m for m in fives if text[: m.start()].split()[-1:] and text[: m.start()].split()[-1] in STATES]
    if behind:
        return behind[-1]
    if len(found) > 1 and found[0].group(3) is None:
        return found[-1]
    return fives[-1] if len(fives) == len(found) and len(fives) > 1 else found[0]


def _street(tokens: list[str]) -> tuple[str | None, str | None, str | None, set[int]]:
    """Number, name, kind and the places of their tokens."""
    numbers = [i for i, t in enumerate(tokens) if HOUSE.match(t)]
    step = lambda i, d: next((k for k in (i + d, i + 2 * d) if 0 <= k < len(tokens) and tokens[k] not in ("|", "|@")), None)
    best = None
    for i in numbers:
        # name in one word with its kind: "reldobjizweg 68"
        for d in (-1, 1):
            k = step(i, d)
            if k is not None and (m := GLUED.match(tokens[k])) and tokens[k].rstrip(".") not in KINDS:
                cost = abs(k - i) + (d > 0) * 0.5
                best = min(best or (99,), (cost, i, m.group(1).replace("-", ""), GLUED_CODE[m.group(2).rstrip(".")], {i, k}), key=lambda x: x[0])
        # number name kind: "12 mosgepnend st"
        for size in (1, 2, 3):
            k = i + 1 + size
            if k < len(tokens) and all(not t.startswith("|") and not t.isdigit() for t in tokens[i + 1 : k + 1]) and (code := _kind(tokens[k], PRECEDING)):
                cost = 1 + (size - 1) * 0.6
                best = min(best or (99,), (cost, i, "".join(tokens[i + 1 : k]), code, set(range(i, k + 1))), key=lambda x: x[0])
        # name kind number: "fifvonxin strasse 125"
        k = step(i, -1)
        if k is not None and k > 0 and not tokens[k - 1].startswith("|") and (code := _kind(tokens[k], PRECEDING)) and len(tokens[k].rstrip(".")) > 2:
            best = min(best or (99,), (1.2, i, tokens[k - 1], code, {i, k, k - 1}), key=lambda x: x[0])
        # kind name number: "via puphibnag, 167"; number kind name: "3, rue pirkonbund"
        back = step(i, -1)
        if back is not None:
            for size in (1, 2, 3):
                k = back - size
                if k >= 0 and all(not t.startswith("|") for t in tokens[k : back + 1]) and (code := _kind(tokens[k], FOLLOWING)):
                    cost = 1 + (size - 1) * 0.6 + (back < i - 1) * 0.3
                    best = min(best or (99,), (cost, i, "".join(tokens[k + 1 : back + 1]), code, {i, *range(k, back + 1)}), key=lambda x: x[0])
        ahead = step(i, 1)
        if ahead is not None and ahead + 1 < len(tokens) and (code := _kind(tokens[ahead], FOLLOWING)) and not tokens[ahead + 1].startswith("|"):
            best = min(best or (99,), (1.1 + (ahead > i + 1) * 0.3, i, tokens[ahead + 1], code, {i, ahead, ahead + 1}), key=lambda x: x[0])
    if best is None:
        return None, None, None, set()
    _, i, name, code, used = best
    return tokens[i].lstrip("0"), re.sub(r"[^a-z0-9]", "", name), code, used


def _town(segments: list[list[str]]) -> tuple[str | None, str | None]:
    """Key of the town, its longest word, and all its letters; of the segment next to the postcode if that has one."""
    best: tuple[int, int, str, str] | None = None
    for order, segment in enumerate(segments):
        beside = "@" in segment
        words = [re.sub(r"[^a-z0-9]", "", w) for t in segment if t != "@" for w in t.split("-")]
        if words and all(t.rstrip(".") in COUNTRIES for t in segment if t != "@"):
            continue
        words = [w for k, w in enumerate(words) if w and not (w in STATES and k > 0) and not w.isdigit()]
        words = [w for w in words if w not in COUNTRIES or len(w) < 3] if len(words) > 1 else words
        whole = "".join(words)
        words = [w for w in words if len(w) > 2] or words
        if words and max(map(len, words)) > 2:
            key = max(reversed(words), key=len)
            rank = (1 if beside else 0, order)
            if best is None or rank > best[:2]:
                best = (*rank, loose(key), loose(whole))
    return best[2:] if best else (None, None)


PARTS = ("number", "street", "kind", "postcode", "town", "town_whole")
FORM = f"struct<{','.join(f'{p}:string' for p in PARTS)}>"


def parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in batches:
        yield pd.DataFrame([parse(v) for v in values], columns=list(PARTS), dtype=object)


def deletions(word: Column) -> Column:
    """The word and all forms with one letter left out: forms of words one typo apart meet."""
    cut = lambda i: F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)))
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(0), F.length(word) - 1), cut)))


def same_town(suffix_a: str = "_a", suffix_b: str = "_b") -> Column:
    """Town keys, or all letters of the towns, up to two letters apart; one for short names."""

    def near(c: str) -> Column:
        a, b = F.col(f"{c}{suffix_a}"), F.col(f"{c}{suffix_b}")
        return F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) < 6, 1).otherwise(2)

    return near("place") | near("place_whole")


def same_street(a: Column, b: Column, most: int) -> Column:
    """Up to ``most`` letters apart, half of the shorter name at most; names of one or two letters must be equal."""
    short = F.least(F.length(a), F.length(b))
    return F.levenshtein(a, b) <= F.when(short < 3, 0).otherwise(F.least(F.lit(most), F.floor(short / 2)))


def address_classes(addresses: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Members (address, class_id) of each parsed form, and links (class_a < class_b) between forms of one place.

    A form needs number, street and kind, and a postcode or a town; other strings are no places and
    stay out, as do NULL and blank ones. Rules: number and kind must be equal (a range is a number of
    its own); streets may differ by typos; two postcodes must be equal; where one is missing the towns
    must agree, a missing town being taken from the postcode's most frequent one.
    """
    values = addresses.select(F.col("address")).where("address is not null").distinct()
    # else the filter on the parts is pushed below the distinction, and all rows are parsed, not the distinct strings
    parsed = values.withColumn("f", F.pandas_udf(parse_batches, FORM).asNondeterministic()("address")).select("address", "f.*")
    usable = parsed.where("number is not null and street <> '' and kind is not null and (postcode is not null or town is not null)")
    members = usable.withColumn("class_id", F.xxhash64("number", "street", "kind", F.coalesce("postcode", F.lit("")), F.coalesce("town", F.lit("")), F.coalesce("town_whole", F.lit(""))))
    # written once: parsed strings are read several times below
    members = cut_lineage(members)
    towns = members.where("postcode is not null and town is not null").groupBy("postcode", "town", "town_whole").count()
    towns = towns.groupBy("postcode").agg(F.max(F.struct("count", "town", "town_whole")).alias("usual"))
    forms = members.select("class_id", *PARTS).dropDuplicates(["class_id"])
    forms = forms.join(towns, "postcode", "left").withColumns({"place": F.coalesce("town", "usual.town"), "place_whole": F.coalesce("town_whole", "usual.town_whole")}).drop("usual")
    one_code = _met(forms, _code_key()).where(same_street(F.col("street_a"), F.col("street_b"), 4))
    one_town = by_town(forms, crowd).where(same_town() & same_street(F.col("street_a"), F.col("street_b"), 2))
    names = ("class_id_a", "class_id_b", "postcode_a", "postcode_b")
    linked = cut_lineage(one_code.select(*names).unionByName(one_town.select(*names)).distinct())
    coded = F.col("postcode_a").isNotNull() & F.col("postcode_b").isNotNull()
    # a form without postcode takes the one that all its linked forms have, and meets the others there
    sides = F.explode(F.array(F.struct(F.col("class_id_a").alias("class_id"), F.col("postcode_b").alias("code")), F.struct(F.col("class_id_b").alias("class_id"), F.col("postcode_a").alias("code"))))
    taken = linked.where(~coded).select(sides.alias("s")).select("s.*").where("code is not null").groupBy("class_id").agg(F.min("code").alias("code"), F.max("code").alias("other"))
    taken = taken.where("code = other").select("class_id", "code")
    completed = forms.join(taken, "class_id", "left").withColumn("given", F.col("postcode").isNotNull())
    completed = completed.withColumn("postcode", F.when(F.col("given"), F.col("postcode")).otherwise(F.col("code"))).drop("code")
    second = _met(completed, _code_key()).where(~F.col("given_a") | ~F.col("given_b")).where(same_street(F.col("street_a"), F.col("street_b"), 4))
    links = linked.select("class_id_a", "class_id_b").unionByName(second.select("class_id_a", "class_id_b"))
    return members.select("address", "class_id"), links.distinct()


def _code_key() -> Column:
    key = F.concat_ws("|", F.lit("p"), "number", "kind", "postcode")
    return F.when(F.col("postcode").isNotNull(), F.array(key)).otherwise(F.array().cast("array<string>"))


def _met(forms: DataFrame, keys: Column) -> DataFrame:
    """Pairs of forms that share a key, columns suffixed _a and _b; a pair may come more than once."""
    keyed = forms.withColumn("key", F.explode(keys))
    names = [c for c in ("class_id", "street", "postcode", "place", "place_whole", "given") if c in keyed.columns]
    side = lambda s: keyed.select("key", *(F.col(c).alias(f"{c}_{s}") for c in names))
    return side("a").join(side("b"), "key").where("class_id_a < class_id_b")


def by_town(forms: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of forms of one number and kind with streets one letter apart, of which at least one has no postcode.

    Where a street of that number stands in many towns, only forms meet whose towns share a segment
    that towns up to two letters apart must share, in place of all; either way the same pairs pass
    ``same_town``. Forms that both have a postcode do not meet here at all.
    """
    by_street = F.transform(deletions(F.col("street")), lambda s: F.concat_ws("|", "number", "kind", s))
    keyed = forms.where("place is not null").select("class_id", "street", "postcode", "place", "place_whole", F.explode(by_street).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("every"), F.count_if(F.col("postcode").isNull()).alias("bare")).where("bare > 0")
    # written once: read by both ways
    keyed = cut_lineage(keyed.join(counts.select("key", (F.col("every") * F.col("bare") > crowd).alias("crowded")), "key"))
    names = ("class_id", "street", "postcode", "place", "place_whole")
    side = lambda df, x, *more: df.select("key", *more, *(F.col(c).alias(f"{c}_{x}") for c in names))
    few, many = keyed.where("not crowded"), keyed.where("crowded")
    plain = side(few.where("postcode is null"), "a").join(side(few, "b"), "key")

    def towns(make) -> Column:
        @F.pandas_udf("array<string>")
        def run(places: pd.Series, wholes: pd.Series) -> pd.Series:
            return pd.Series([sorted({f"p{k}" for k in make(p, TOWN_EDITS)} | {f"w{k}" for k in make(w, TOWN_EDITS)}) for p, w in zip(places, wholes, strict=True)], dtype=object)

        return F.explode(run("place", F.coalesce("place_whole", "place"))).alias("town_key")

    index, probe = many.select("*", towns(segments)), many.where("postcode is null").select("*", towns(probes))
    split = side(probe, "a", "town_key").join(side(index, "b", "town_key"), ["key", "town_key"]).drop("town_key")
    met = plain.unionByName(split).drop("key").where("class_id_a <> class_id_b")
    swap = F.col("class_id_a") > F.col("class_id_b")
    turned = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in names for x, y in ("ab", "ba")]
    return met.select(*turned)


def pairs_of(members: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """All pairs of different member values of one class or of linked classes, the smaller first."""
    left = members.select("class_id", F.col(value).alias("x"))
    right = members.select("class_id", F.col(value).alias("y"))
    within_class = left.join(right, "class_id").where("x < y").select("x", "y")
    across = links.join(left.withColumnRenamed("class_id", "class_id_a"), "class_id_a").join(right.withColumnRenamed("class_id", "class_id_b"), "class_id_b")
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within_class.unionByName(across).select(F.col("x").alias(f"{value}_a"), F.col("y").alias(f"{value}_b"))


def place_classes(addresses: DataFrame) -> DataFrame:
    """address, place_id, spellings of each string that denotes a place: forms that links join over any number of steps are one place."""
    members, links = address_classes(addresses)
    counted = members.groupBy(F.col("class_id").alias("node")).agg(F.count("*").alias("weight"))
    rooted = components(counted, links.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")))
    sizes = rooted.join(counted, "node").groupBy("root").agg(F.sum("weight").alias("spellings"))
    found = members.join(rooted.withColumnRenamed("node", "class_id"), "class_id").join(sizes, "root")
    return found.select("address", F.col("root").alias("place_id"), "spellings")


ADDRESS_FIELDS = ("supplier_address", "buyer_address", "ship_to_address", "bill_to_address")


def address_pairs(orders: DataFrame, fields: tuple[str, ...] = ADDRESS_FIELDS) -> DataFrame:
    """address_a, address_b of all pairs of different stored strings for one place."""
    values = orders.select(F.explode(F.array(*fields)).alias("address"))
    members, links = address_classes(values)
    return pairs_of(members, links, "address")
