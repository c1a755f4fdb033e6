"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised (lower case, letters and digits only, single
spaces) and looked up among known licence sentences; the sequence of identifiers found is then
matched against ordered licence rules, longest first.  A sentence may be wrapped over lines; a
line break ends a sentence only if no known sentence goes on over it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.llm._frames import checked_name

# Known licence sentences, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Ordered rules, a licence and the sentences that name it.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-disclaimer")),
    ("MIT", ("mit-grant", "mit-condition", "mit-disclaimer")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
)
# Every known sentence holds one of these; a text without any holds no sentence.
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "warranty")

_BREAK = re.compile(r"(?<=[.!?;:])[^\S\n]+|[^\S\n]*\n\s*")
_ENDS = re.compile(r"[.!?;:]\Z")
_OTHER = re.compile(r"[\W_]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


class Recogniser:
    """``gap``: how many unknown sentences may stand between two sentences of a rule."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, triggers: tuple = TRIGGERS, gap: int = 2):
        missing = [k for k, s in sentences.items() if not any(t in s.lower() for t in triggers)]
        if missing:
            raise ValueError(f"sentences without a trigger: {', '.join(missing)}")
        self.known = {normalised(s): k for k, s in sentences.items()}
        self.longest = max((len(s) for s in self.known), default=0)
        self.rules = sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), r[0]))
        self.triggers, self.gap = triggers, gap

    def sentences(self, text: str) -> list[str | None]:
        """Identifier of each sentence in order, None for unknown ones."""
        parts = [(normalised(p), bool(_ENDS.search(p))) for p in _BREAK.split(text)]
        out: list[str | None] = []
        i = 0
        while i < len(parts):
            found, joined, after = None, "", i + 1
            for j in range(i, len(parts)):
                joined = f"{joined} {parts[j][0]}".strip()
                if len(joined) > self.longest:
                    break
                if joined in self.known:
                    found, after = self.known[joined], j + 1
                if parts[j][1] and j > i and joined not in self.known and not self._goes_on(joined):
                    break
            if found or parts[i][0]:
                out.append(found)
            i = after
        return out

    def _goes_on(self, joined: str) -> bool:
        return any(s.startswith(joined) for s in self.known)

    def matches(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, first sentence, number of known sentences) of each rule matched, in text order."""
        if not text:
            return []
        low = text.lower()
        if not any(t in low for t in self.triggers):
            return []
        ids = [(n, k) for n, k in enumerate(self.sentences(text)) if k]
        out, at = [], 0
        while at < len(ids):
            for _, (licence, wanted) in self.rules:
                run = ids[at : at + len(wanted)]
                if [k for _, k in run] == list(wanted) and all(b[0] - a[0] - 1 <= self.gap for a, b in zip(run, run[1:], strict=False)):
                    out.append((licence, run[0][0], len(run)))
                    at += len(run)
                    break
            else:
                at += 1
        return out


_MATCHES = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("first_sentence", T.LongType()), T.StructField("n_sentences", T.LongType())]))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """Per row: the id column, ``licences`` (distinct, sorted), ``n_matches`` and ``matches`` in text order.

    Defined cases: a null or empty text has no licences; a known sentence that completes no rule is not
    a match; repeated sentences match each time; repeated rows get the same result; where two rules of
    equal length fit, the first listed wins; other columns are not looked at; empty tables are fine.
    """
    checked_name(docs, id_col, text_col)
    recogniser = recogniser or Recogniser()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("licence", pa.string()), ("first_sentence", pa.int64()), ("n_sentences", pa.int64())]))
        for batch in batches:
            found = [recogniser.matches(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([[{"licence": a, "first_sentence": b, "n_sentences": c} for a, b, c in f] for f in found], kind),
                ],
                names=[id_col, "licences", "n_matches", "matches"],
            )

    schema = T.StructType([docs.schema[id_col], T.StructField("licences", T.ArrayType(T.StringType())), T.StructField("n_matches", T.LongType()), T.StructField("matches", _MATCHES)])
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
