from pyspark.sql import functions as F

from orderloom.llm.addresses import ADDRESS_FIELDS, address_classes, address_pairs, parse, place_classes

ONE = [
    "123 Gepnotval Boulevard, Maple Darrow, WI 70590", "123 GEPNOTVAL BLVD.\nMAPLE DARROW, WI 70590", "Maple Darrow, WI 70590, 123 Gepnotval Blvd., US", "Attn: Goods In, 123 Gepnotvl Blvd, Maple Darrow",
    "Acme Optics Ltd, Dock 4, No. 123 Gepnotval Boulevard; 70590", "123 Gepnotval Blvd., Mapled Arrow", "123 Gepn0tval Blvd - Maple Darow 70590 - United States",
]
TWO = ["Reldobjizweg 68, 3730 GJ Sint Orbeek", "3730GJ Sint Orbeek - Reldobjizwg. # 68 - NL", "RELDOBJIZ-WEG 68 3730 GJ SINT ORBEEK NETHERLANDS"]
OTHERS = [
    "321 Gepnotval Boulevard, Maple Darrow, WI 70590", "123 Gepnotval Road, Maple Darrow, WI 70590", "123 Gepnotval Boulevard, Fort Orlen, OH 49537", "Reldobjizstraat 68, 3730 GJ Sint Orbeek",
    "Reldobjizweg 68, 5156 GM Veldhoorn",
]


def pairs(spark, values):
    df = spark.createDataFrame([(v, None) for v in values], "supplier_address string, buyer_address string").withColumns({c: F.lit(None).cast("string") for c in ("ship_to_address", "bill_to_address")})
    return sorted(tuple(r) for r in address_pairs(df).collect())


def all_pairs(group):
    return [(a, b) for a in group for b in group if a.encode() < b.encode()]


def test_components():
    assert parse("C/ Subbulsim, 112, Halle 3, 84965 Torremira, España") == ("112", "subbulsim", "cl", "84965", "torremira", "torremira")
    assert parse("3, r. Pirkonbund, 2nd Floor, 41107 Montbrècy") == ("3", "pirkonbund", "r", "41107", "montbrecy", "montbrecy")
    assert parse("Fifvonxin Strasse 125, D-52467 Königsfelde") == ("125", "fifvonxin", "str", "52467", "konigsfelde", "konigsfelde")
    assert parse("ul. Ruxsodtik 185\n53-714 Nowa Orlawa\nPolska") == ("185", "ruxsodtik", "ul", "53-714", "orlawa", "nowaorlawa")
    assert parse("7 Senpabmil Rd Aldermoth MR21 1EN")[:4] == ("7", "senpabmil", "rd", "mr211en")
    assert parse("") == (None,) * 6 and parse("Acme Ltd")[:3] == (None,) * 3


def test_groups_and_decoys(spark):
    values = ONE + TWO + OTHERS
    assert pairs(spark, values + values) == sorted(all_pairs(ONE) + all_pairs(TWO))


def test_against_every_pair(spark, data):
    """The keys lose no pair that the rules would link: compared with all pairs of a small fixture."""
    from orderloom.llm.folding import within

    orders = spark.read.parquet(f"{data}/purchase_orders.parquet")
    values = sorted({r[0] for f in ("supplier_address", "buyer_address", "ship_to_address", "bill_to_address") for r in orders.select(f).distinct().collect() if r[0]})
    parsed = {v: parse(v) for v in values}
    found = {tuple(r) for r in address_pairs(orders).collect()}
    sure = set()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            p, q = parsed[a], parsed[b]
            if None not in p[:3] and p[0] == q[0] and p[2] == q[2] and p[3] and p[3] == q[3] and q[1] and within(p[1], q[1], 2):
                sure.add(tuple(sorted((a, b), key=str.encode)))
    assert sure <= found and len(found) < len(sure) * 1.6 + 20


def test_odd_input(spark):
    assert pairs(spark, [None, "", " ", "no number here", "x" * 100_000, "5", "5", "12345"]) == []
    df = spark.createDataFrame([], "supplier_address string, buyer_address string, ship_to_address string, bill_to_address string")
    assert address_pairs(df).count() == 0
    odd = spark.createDataFrame([(v, v, None, None) for v in TWO], df.schema).withColumns({c: F.lit("z") for c in ("address", "number", "key", "class_id", "postcode", "place")})
    assert address_pairs(odd).count() == 3


def test_long_numbers_ranges_and_short_streets(spark):
    groups = [
        ["12345 Gepnotval Road, Maple Darrow, WI 70590", "12345 GEPNOTVAL RD\nMAPLE DARROW, WI 70590", "Maple Darrow, WI 70590, 12345 Gepnotval Rd., US"],
        ["12-14 Gepnotval Road, Maple Darrow, WI 70590", "12-14 Gepnotval Rd, Maple Darrow 70590"], ["12 Gepnotval Road, Maple Darrow, WI 70590", "No. 12 Gepnotval Rd, Maple Darrow 70590"],
        ["12 Ox Road, Maple Darrow, WI 70590", "12 OX RD, MAPLE DARROW 70590"], ["12 Ax Road, Maple Darrow, WI 70590"],
    ]
    assert pairs(spark, [v for g in groups for v in g]) == sorted(p for g in groups for p in all_pairs(g))


def test_crowded_streets_give_the_same_pairs(spark, data):
    """A street of one number in many towns: found by segments of towns as by comparing all, whatever the bound."""
    towns = ["Maple Darrow", "Mapel Darrow", "Fort Orlen", "Fort Orlem", "Sint Orbeek", "Veldhoorn", "Veldhorn", "Nowa Orlawa", "Brackenwick", "Oxhollow", "Pendleworth", "Aldermoth"]
    values = [f"1 Gepnotval Road, {t}{code}" for k, t in enumerate(towns) for code in ("", f", WI {70590 + k}")]
    stored = spark.read.parquet(f"{data}/purchase_orders.parquet").select(F.explode(F.array(*ADDRESS_FIELDS)).alias("address"))
    for df in (spark.createDataFrame([(v,) for v in values], "address string"), stored):
        found = [sorted(map(tuple, address_classes(df, crowd)[1].collect())) for crowd in (0, 10**9)]
        assert found[0] == found[1] and found[0]


def test_classes(spark):
    rows = place_classes(spark.createDataFrame([(v,) for v in ONE + TWO + OTHERS], "address string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.place_id, set()).add(r.address)
    assert set(map(frozenset, by.values())) == {frozenset(ONE), frozenset(TWO), *(frozenset([x]) for x in OTHERS)}
    assert all(r.spellings == len(by[r.place_id]) for r in rows)
