"""License scan: a trained paragraph classifier, confirmed by templates. DataFrame and SQL functions only.

Paragraphs become sparse word n-grams: what stands between blank lines, cut further at line ends after a full stop, so
that a wrapped notice is one paragraph. A multinomial logistic regression, fitted by Spark ML on the notices
below, on parts of them and on sentences that merely sound alike, names the licence family or `unknown`. Its
probabilities are calibrated by a temperature chosen on examples left out of a first fit. A prediction is confirmed
if the paragraph's word pairs agree with a template of the predicted family; templates are texts of their own, which
the model isn't fitted on. Texts are read once, and nothing is shuffled.

An n-gram is a feature only if it holds an anchor word, so a paragraph without any anchor has no feature and is
`unknown` by construction: it is passed over before any word is looked at. The model is a table of n-grams with a
weight for each family; its size follows from the notices here, not from the corpus.

Results in corner cases: null and empty texts and texts without an anchor give no row; a paragraph with an anchor that
is no licence gives a row with family `unknown`; ties go to the first family by name; repeated rows give repeated
results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

UNKNOWN = "unknown"
# Customary notices by licence family; the model is fitted on them.
NOTICES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL-3.0.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the AGPL license.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution Non-Commercial license.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Licensed under CC0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v3.",
        "Released under the GNU GPL, version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL v3 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the MPL 2.0 license.",
    ],
    "proprietary": [
        "Copyright Example Inc. All rights reserved.",
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "Unauthorized copying of this file is strictly prohibited; proprietary license.",
        "This software is the proprietary and confidential property of its owner and may be used under a commercial license only.",
    ],
}
#: Sentences with anchor words that are no licence.
OTHERS = [
    "His driving license was renewed in March.",
    "The council granted a licence to sell wine.",
    "She asked for permission to leave the room.",
    "With your permission we will begin the meeting now.",
    "The warranty on the car covers the engine for two years.",
    "The court heard a case about copyright law and music.",
    "A licensed electrician must check the wiring.",
    "The station lost its broadcasting license last year.",
    "An Apache helicopter landed near the village.",
    "The Apache people lived in the southwest.",
    "A fishing licence is required on this river.",
    "Copyright disputes between the two publishers went on for years.",
    "Drivers without a license pay a fine.",
    "He has a license to practise medicine.",
    "The redistribution of land took a decade.",
    "Redistribution of wealth was the topic of the debate.",
    "Parking is by permission of the owner only.",
    "The police issued a warrant for his arrest.",
    "There is no warranty for used goods in this shop.",
    "Restaurants need a liquor license from the city.",
    "The photograph is in a museum and no permission is needed to see it.",
    "Licensed drivers may rent a boat here.",
    "The film was licensed to a television channel.",
    "A software license costs ten dollars a month for each user.",
    "The author explains copyright and patents to students.",
    "Tickets come with all rights reserved for their holders.",
    "They reserved seats with all the rights of members.",
    "The bank was licensed under the new law.",
    "The shop sells its goods without warranty of any kind to the trade.",
    "He gave a public lecture on the domain of the eagle.",
    "The creative commons of the village are its meadow and its pond.",
    "A licence is granted to any person over eighteen.",
]
# Names of licences, for short templates, and the texts of notices.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "AGPL v3", "AGPL license"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution Non-Commercial license"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0", "CC0 1.0 Universal", "CC0-1.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GPL v3", "GPL-3.0-or-later", "GNU GPL"],
    "lgpl": ["GNU Lesser General Public License", "LGPL", "LGPL v3", "LGPL-2.1-or-later"],
    "mit": ["MIT License", "MIT"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "proprietary": ["proprietary license", "commercial license only"],
}
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": ["This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."],
    "cc-by-nc": ["This is an open access article distributed under the terms of the Creative Commons Attribution-NonCommercial License, which permits use, distribution and reproduction in any medium for non-commercial purposes only."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": [
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
        "This work has been dedicated to the public domain.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Where a text is cut into paragraphs.
_CUTS = r"\n[ \t\r]*\n\s*|(?<=[.!?])[ \t\r]*\n"
#: What makes a word an anchor, as patterns for the start of a word.
ANCHORS = ("licen[cs]", "copyright", "gpl", "lgpl", "agpl", "mpl", "gnu", "affero", "apache", "creative", "commons", "cc-by", "cc0", "warrant", "redistribut", "permission", "spdx", "bsd", "mozilla", "rights", "domain", "unencumbered", "cc", "proprietary")
_GATE = r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(ANCHORS) + ")"
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_ANCHOR = r"(?:^| )(?:" + "|".join(ANCHORS) + ")"


def words(paragraph: Column) -> Column:
    """Words of a paragraph in lower case; cc by and cc-by are one."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(paragraph), r"\bcc by\b", "cc-by"), F.lit(f"({_TOKEN})"), F.lit(1))


def grams(w: Column, n: int) -> Column:
    """Distinct n-grams of an array of words."""
    last = F.size(w) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i + 1, n))))


def features(w: Column) -> Column:
    """1- to 3-grams that hold an anchor word; the longer ones without which a family can't be told from another."""
    every = F.concat(grams(w, 1), grams(w, 2), grams(w, 3))
    return F.array_distinct(F.filter(every, lambda g: g.rlike(_ANCHOR)))


def examples(spark: SparkSession) -> DataFrame:
    """family, text, fold: notices and other sentences, whole and in parts of two thirds of their words."""
    rows = []
    for family, texts in [*NOTICES.items(), (UNKNOWN, OTHERS)]:
        for k, t in enumerate(texts):
            w = t.split()
            cut = max(4, len(w) * 2 // 3)
            parts = {t, " ".join(w[:cut]), " ".join(w[-cut:])} if len(w) > 6 else {t}
            rows += [(family, p, k % 3) for p in sorted(parts)]
    rows += [(UNKNOWN, w, k % 3) for k, w in enumerate(["license", "permission", "copyright", "warranty", "rights", "domain", "creative", "apache", "commons"])]
    return spark.createDataFrame(rows, "family string, text string, fold int")


@lru_cache(maxsize=4)
def _fitted(app: str) -> tuple[list[str], list[float], list[tuple]]:
    """Families, intercepts, and (n-gram, weights by family), all divided by the temperature; once a session."""
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    spark = SparkSession.active()
    data = examples(spark).withColumn("grams", features(words(F.col("text")))).coalesce(1).cache()
    families = sorted({*NOTICES, UNKNOWN})
    label = F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(families) for x in (f, float(k)))), F.col("family"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(data)
    data = vocabulary.transform(data).withColumn("label", label).select("features", "label", "fold").cache()
    learner = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.1, maxIter=80, standardization=False)
    out = learner.fit(data.filter("fold != 0")).transform(data.filter("fold = 0")).select("label", vector_to_array("rawPrediction").alias("raw")).collect()

    def loss(t: float) -> float:
        total = 0.0
        for r in out:
            z = [x / t for x in r["raw"]]
            top = max(z)
            total += top + math.log(sum(math.exp(x - top) for x in z)) - z[int(r["label"])]
        return total

    t = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    model = learner.fit(data)
    w = model.coefficientMatrix.toArray() / t
    weights = [(g, [float(x) for x in w[:, k]]) for k, g in enumerate(vocabulary.vocabulary) if abs(w[:, k]).max() > 1e-6]
    return families, [float(x) / t for x in model.interceptVector], weights


def templates(family: str) -> list[str]:
    """Texts that confirm a prediction."""
    return [f"{how} {name}" for name in NAMES[family] for how in ("Licensed under", "Licensed under the", "Released under the", "SPDX-License-Identifier:")] + TEMPLATES[family]


def scan(docs: DataFrame, sure: float = 0.5, agree: float = 0.5) -> DataFrame:
    """A row for each paragraph with an anchor word: doc_id, paragraph (its number from 0), family (`unknown` where
    no family has a calibrated probability of at least `sure`, or no template of it agrees), probability, similarity
    (share of the word pairs of the shorter of paragraph and template that both hold), confirmed, text."""
    spark = docs.sparkSession
    families, bias, weights = _fitted(spark.sparkContext.applicationId)
    found = pick(docs, "doc_id", "text").filter(F.col("text").rlike(_GATE)).select("doc_id", F.posexplode(F.split("text", _CUTS)).alias("paragraph", "text"))
    found = found.filter(F.col("text").rlike(_GATE)).withColumn("w", words(F.col("text")))
    # tables of a size that follows from the notices: each becomes one constant
    table_of = F.from_json(F.lit(json.dumps({g: [round(x, 6) for x in v] for g, v in weights})), "map<string, array<double>>")
    zero = F.array(*(F.lit(b) for b in bias))
    z = F.aggregate(features(F.col("w")), zero, lambda acc, g: F.coalesce(F.zip_with(acc, F.try_element_at(table_of, g), lambda x, y: x + y), acc))
    top = F.array_max("z")
    scored = found.withColumn("z", z).withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    scored = scored.withColumn("guess", F.element_at(F.array(*map(F.lit, families)), F.array_position("z", top).cast("int")))
    known = F.from_json(F.lit(json.dumps({f: templates(f) for f in NAMES})), "map<string, array<string>>")
    pairs_of = F.transform(F.coalesce(F.try_element_at(known, F.col("guess")), F.array().cast("array<string>")), lambda t: grams(words(t), 2))
    both = F.transform(pairs_of, lambda p: F.size(F.array_intersect(p, F.col("pairs"))) / F.greatest(F.lit(1), F.least(F.size(p), F.size("pairs"))))
    out = scored.withColumn("pairs", grams(F.col("w"), 2)).withColumn("similarity", F.coalesce(F.array_max(both), F.lit(0.0)))
    confirmed = (F.col("guess") != UNKNOWN) & (F.col("probability") >= sure) & (F.col("similarity") >= agree)
    return out.select("doc_id", "paragraph", F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"), F.col("guess").alias("predicted"), "probability", "similarity", confirmed.alias("confirmed"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE = {}
