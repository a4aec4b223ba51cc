"""The service's endpoints as methods: each returns a dict of plain values and DataFrames."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame

from tagwright.functions.patterns import is_wildcard
from tagwright.operators import boolean, exclude, paging, stats, validate, wildcard
from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL, OPERATORS, TagQuery, bool_param, text_param

log = logging.getLogger(__name__)


class Api:
    """default_patterns: the exclusion list that requests can ask for by a flag."""

    def __init__(self, engine: Engine, default_patterns: Sequence[str] = ()):
        self.engine, self.default_patterns = engine, tuple(default_patterns)

    def _excluded(self) -> tuple[str, ...]:
        return tuple(r["tag"] for r in wildcard.expand(self.engine, self.default_patterns).orderBy("tag").collect())  # of a list kept by hand

    def _total(self, tag: str) -> int:
        return stats.total(self.engine, tag).first()["n"]

    def tag(self, tag: str, params: Mapping[str, str]) -> dict:
        start = time.monotonic()
        q = TagQuery.from_params(tag, {k: v for k, v in params.items() if k.lower() not in ("othertag", "operator")})
        results = paging.fetch(self.engine, paging.tag_page(self.engine, q))
        return {"statistics": {"elapsed_ms": int(1000 * (time.monotonic() - start)), "total_questions_for_tag": self._total(tag)}, "results": results}

    def query(self, tag: str, params: Mapping[str, str]) -> dict:
        start = time.monotonic()
        excluded = self._excluded() if bool_param(params, "useDefaultExclusions", False) else ()
        q = TagQuery.from_params(tag, params, excluded)
        if q.other_tag is None:
            raise ValueError("a query needs two tags")
        found = boolean.run(self.engine, q)
        out: dict = {"statistics": {"elapsed_ms": int(1000 * (time.monotonic() - start)), "total_questions_per_tag": {t: self._total(t) for t in (q.tag, q.other_tag)}}, "results": paging.fetch(self.engine, found)}
        if bool_param(params, "counters", False):
            out["statistics"]["counters"] = boolean.counters(self.engine, q).first().asDict()
        if bool_param(params, "debugMode", False):
            out["debugging"] = {"invalid_results": validate.invalid_results(self.engine, found, q), "should_be_excluded": validate.leaks(self.engine, found, excluded)}
        log.info("%s %s %s: %d ms", q.tag, q.operator, q.other_tag, out["statistics"]["elapsed_ms"])
        return out

    def question(self, id_: int) -> DataFrame:
        return paging.lookup(self.engine, id_)

    def wildcards(self, params: Mapping[str, str]) -> dict:
        listed = [p for p in text_param(params, "wildcards", "").split(",") if p]
        patterns = [*listed, *(self.default_patterns if bool_param(params, "useDefaultWildcards", False) else ())]
        if not patterns:
            return {"n_patterns": 0, "counts": None, "lists": None}
        return {"n_patterns": len(patterns), "counts": wildcard.counts(self.engine, patterns), "lists": wildcard.lists(self.engine, patterns)}

    def default_list(self) -> dict:
        return {"size": len(self.default_patterns), "wildcards": sorted(filter(is_wildcard, self.default_patterns)), "all": sorted(self.default_patterns)}

    def default_expanded(self) -> DataFrame:
        return wildcard.expand(self.engine, self.default_patterns).orderBy("tag")

    def coverage(self) -> DataFrame:
        return exclude.pattern_coverage(self.engine, self.default_patterns)

    def info(self) -> dict:
        top = stats.extreme_tags(self.engine)
        some = [r["tag"] for r in top.limit(2).collect()]
        return {"total_questions": self._total(ALL), "top_tags": top, "bottom_tags": stats.extreme_tags(self.engine, most=False), "messages": list(self.engine.messages), "sample_urls": sample_urls(*some) if len(some) == 2 else []}


def sample_urls(a: str, b: str) -> list[str]:
    """Requests to try: a page of a tag, and each operator on two tags."""
    one, two = quote(a, safe=""), quote(b, safe="")
    pages = [f"/api/Tags/{one}?type={kind}&pageSize=25&skip=0" for kind in ("Score", "ViewCount", "CreationDate")]
    return pages + [f"/api/Query/{one}?type=ViewCount&otherTag={two}&operator={op}&useDefaultExclusions=true" for op in OPERATORS]


def respond(out: object) -> str:
    """A response as JSON text. Tables in it are pages or lists of tags; they become arrays of objects."""

    def plain(x: object) -> object:
        if isinstance(x, DataFrame):
            return [json.loads(r) for r in x.toJSON().collect()]
        if isinstance(x, Mapping):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(out), ensure_ascii=False)
