"""What the signatures of operator 6 are kept as between their passes."""

from staylens.llm import neardup


def test_bands_are_kept_as_few_wide_rows(spark):
    forms = [(f"{i:04d}", f"{'same words again ' * 3}{i}" if i % 2 else f"{i * 7919:030b}" * 2) for i in range(300)]
    classes = spark.createDataFrame(forms, "class_id string, form string").repartition(3)
    packed = neardup._signed(classes, 6, 2, 3, 20)
    kept = packed.collect()
    assert len(kept) <= 3 and sum(len(r["ids"]) for r in kept) == 300
    rows = neardup._band_rows(packed, 6).collect()
    assert len(rows) == 6 * 300 == len({(r["class_id"], r["bucket"]) for r in rows})
    hot = {x for r in kept for x in r["hot"]}
    counted = {}
    for r in rows:
        counted[r["bucket"]] = counted.get(r["bucket"], 0) + 1
    assert hot and all(counted[x] > 20 for x in hot) and {x for x, n in counted.items() if n > 60} <= hot
    assert neardup._band_rows(neardup._signed(classes.where("false"), 6, 2, 3, 20), 6).count() == 0
