"""Table functions for SQL: wiki_sections, wiki_links and wiki_claims of a text, for use in LATERAL joins.

`register(spark)` makes them known. They give what the column forms give (`text.sections`, `text.relations`,
`pages.claim_array`). Rows go to Python in small batches, not in Arrow ones of 10,000 whole texts, so that a worker's
memory doesn't grow with the table; queries in the DataFrame API do better with the column forms, which stay in the JVM. A null text has no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as T

SPACE = " \t\n\x0b\f\r"
_LINK, _CITED, _WORDS = re.compile(T.LINK), re.compile(T.SOURCE, re.ASCII), re.compile(f"[^{SPACE}]+")
_SUFFIX = re.compile(rf":({'|'.join(T.RELATIONS)})\b")


@udtf(returnType="ord int, heading string, body string", useArrow=False)
class Sections:
    """The second-level sections; of equal headings the first place and the last body."""

    def eval(self, content: str) -> Iterator[tuple]:
        found: dict[str, str] = {}
        for part in re.split(r"^##[ \t]+", content, flags=re.M)[1:] if content else ():
            heading, _, body = part.partition("\n")
            found[heading.strip(" ")] = body.strip(SPACE)
        yield from ((i, h, b) for i, (h, b) in enumerate(found.items()))


@udtf(returnType="pos int, target string, rel string", useArrow=False)
class Links:
    """The links in order, with the relation behind each or among the three words before it."""

    def eval(self, content: str) -> Iterator[tuple]:
        # The last words so far; the last one may go on where the next stretch begins.
        words, at = deque([""], 4), 0
        for i, m in enumerate(_LINK.finditer(content or "")):
            self._take(words, content[at : m.start()])
            near = [*words]
            near[-1] = near[-1][:-1]
            last = [w.lower() for w in near if w][-3:]
            suffix = _SUFFIX.match(content, m.end())
            yield i, m[1], suffix[1] if suffix else next((w for w in reversed(last) if w in T.RELATIONS), "neutral")
            self._take(words, m[0])
            at = m.end()

    @staticmethod
    def _take(words: deque, stretch: str) -> None:
        """Of a word too long for a relation only the beginning is kept, and that it doesn't end."""
        ends = _WORDS.findall(stretch)
        if ends and stretch[0] not in SPACE:
            words[-1] = (words[-1] + ends.pop(0))[: T.WORD_MOST]
        elif stretch and words[-1]:
            words.append("")
        for w in ends[-4:]:
            if words[-1]:
                words.append("")
            words[-1] = w[: T.WORD_MOST]
        if stretch and stretch[-1] in SPACE and words[-1]:
            words.append("")


@udtf(returnType="claim_no int, text string, section string, sources array<string>, refs array<struct<source:string,section:string>>", useArrow=False)
class Claims:
    """Lines with a citation outside of Sources, without markup, numbered from 1."""

    def eval(self, content: str) -> Iterator[tuple]:
        section, n = "", 0
        for raw in (content or "").split("\n"):
            line = raw.strip(SPACE)
            if head := re.match(r"##\s+(.+)$", line, re.ASCII):
                section = head[1].strip(SPACE) or section
                continue
            if section == "Sources" or not (cited := _CITED.findall(line)):
                continue
            text = re.sub(r"^[-*]\s+", "", line, flags=re.ASCII).strip(SPACE)
            bare = re.sub(r"\s+", " ", _CITED.sub("", re.sub(r"\*\*([^*]+)\*\*", r"\1", text)), flags=re.ASCII).strip(" .")
            if text.startswith("[source:") or len(bare) < 12:
                continue
            n += 1
            refs = [(name.strip(" "), part.strip(" ")) for name, part in cited]
            yield n, bare, section, sorted({name for name, _ in refs}), refs


def register(spark: SparkSession) -> None:
    for name, table in (("wiki_sections", Sections), ("wiki_links", Links), ("wiki_claims", Claims)):
        spark.udtf.register(name, table)
