"""License notices in texts, found by MinHash bands over overlapping windows; native expressions only.

Words are runs of letters and digits, lower-cased in A-Z; shingles are five words. A template of ``n`` shingles is
looked for with windows of 1, 4 or 16 shingles: the largest size for which windows at half-size steps cannot avoid
lying inside the notice. Every window of a template is indexed, whatever its offset, so an exact copy always
has a window equal to an indexed one and collides in all bands. At a similarity of 0.8 between the windows a pair
misses all of ``BANDS`` bands of one row with probability 0.2^4 = 0.0016, and a notice has several windows.

A collision only proposes a template. The text's shingles decide: the largest share of the template's distinct
shingles that lies within ``1.25 n`` consecutive shingles of the text must be ``CONTAINED`` or more.

Templates are a parameter of bounded size; their index is a literal in the plan. So the texts are read once, and
nothing is joined or shuffled. Defined results: null texts and texts under five words match nothing; rows repeated
match repeatedly; a template under five words is refused. A template of fewer than five shingles has windows of one: its
shingles are looked up as they are. Notices that share most of their words, as those of one family do, may each be found.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lower_ascii

WORDS = r"[\p{L}\p{N}]+"
SHINGLE, SIZES, BANDS, CONTAINED = 5, (1, 4, 16), 4, 0.8
_MASKS = [random.Random(i).getrandbits(64) - 2**63 for i in range(BANDS)]

#: Notices as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
        "later version."
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely"
    ),
}


def shingles(text: Column) -> Column:
    """64-bit hashes of all runs of five words, in order."""
    hashed = F.transform(F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))

    def joined(words):
        count = F.size(words) - SHINGLE + 1
        return F.when(count > 0, F.transform(
            F.sequence(F.lit(1), count), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)])
        )).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(hashed, joined)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _masked(mask: int):
    """A hash function of its own: numbers near the mask, bit by bit from the top, are least."""
    return lambda x: x.bitwiseXOR(F.lit(mask))


def _one_of(keys: list[int]):
    return lambda k: k.isin(keys)


def window_size(count: int) -> int:
    """The largest size of which some window at half-size steps lies inside ``count`` shingles."""
    return max(s for s in SIZES if s + max(1, s // 2) - 1 <= count)


def band_keys(found: Column, size: int, step: int) -> Column:
    """Keys of all bands of the windows of ``size`` shingles at every ``step``, and of the last window."""
    if size == 1:
        return F.transform(found, lambda x: F.xxhash64(x, F.lit(1)))
    last = F.size(found) - size + 1

    def keys(start):
        window = F.slice(found, start, size)
        return F.array(*[F.xxhash64(F.array_min(F.transform(window, _masked(m))), F.lit(size), F.lit(i)) for i, m in enumerate(_MASKS)])

    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last)))
    return F.when(last > 0, F.flatten(F.transform(starts, keys))).otherwise(F.expr("cast(array() as array<bigint>)"))


def indexed(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Per template its name, distinct shingles, window size and the keys of all its windows."""
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "name string, text string")
    found = rows.select("name", shingles(F.col("text")).alias("s")).collect()
    out = []
    for row in found:
        if not row["s"]:
            raise ValueError(f"template {row['name']} has fewer than {SHINGLE} words")
        size = window_size(len(row["s"]))
        out.append({"name": row["name"], "shingles": list(dict.fromkeys(row["s"])), "count": len(row["s"]), "size": size})
    for t in out:
        one = spark.createDataFrame([(t["name"],)], "name string").select(
            band_keys(F.lit([*next(r["s"] for r in found if r["name"] == t["name"])]), t["size"], 1).alias("keys")
        )
        t["keys"] = sorted(set(one.first()["keys"]))
    return out


def _best(found: Column, template: dict) -> Column:
    """``struct<license,containment,start_word>`` of the best stretch for one template."""
    own, reach = template["shingles"], template["count"] + template["count"] // 4
    places = F.filter(F.transform(found, lambda x, i: F.when(x.isin(own), F.struct(i.alias("at"), x.alias("x")))), lambda p: p.isNotNull())

    def scored(listed):
        def share(p, i):
            # Places ascend, so at most as many of them lie within reach; the work grows with the text, not its square.
            near = F.filter(F.slice(listed, i + 1, reach), lambda q: q["at"] < p["at"] + reach)
            distinct = F.size(F.array_distinct(F.transform(near, lambda q: q["x"])))
            return F.struct((distinct / F.lit(float(len(own)))).alias("containment"), (-p["at"]).alias("minus"))

        return F.array_max(F.transform(listed, share))

    best = _let(places, scored)
    return F.struct(F.lit(template["name"]).alias("license"), best["containment"].alias("containment"), (-best["minus"]).alias("start_word"))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """A row per row of ``docs`` and template found: the columns of ``docs`` but the text, and ``license, containment,
    start_word`` (the word, from 0, at which the best stretch starts; the first of equals)."""
    known = indexed(docs.sparkSession, TEMPLATES if templates is None else templates)
    kept = [F.col(c) for c in docs.columns if c != text]
    sizes = sorted({t["size"] for t in known})
    none = F.expr("cast(array() as array<struct<license:string,containment:double,start_word:int>>)")

    def hits(found):
        """Per window size the keys that some template has."""
        return F.struct(*[
            F.filter(band_keys(found, size, max(1, size // 2)), _one_of(sorted({k for t in known if t["size"] == size for k in t["keys"]})))
            .alias(f"h{size}") for size in sizes
        ])

    def verified(found):
        def matches(h):
            some = F.size(h[f"h{sizes[0]}"]) > 0
            for size in sizes[1:]:
                some = some | (F.size(h[f"h{size}"]) > 0)
            best = F.array(*[F.when(F.exists(h[f"h{t['size']}"], _one_of(t["keys"])), _best(found, t)) for t in known])
            return F.when(some, F.filter(best, lambda m: m["containment"] >= contained)).otherwise(none)

        return _let(hits(found), matches)

    # One expression, in which every step is a variable: as columns, the optimiser would repeat them.
    found = docs.where(F.col(text).isNotNull()).select(*kept, F.explode(_let(shingles(F.col(text)), verified)).alias("_m"))
    return found.select(*kept, "_m.license", "_m.containment", "_m.start_word")
