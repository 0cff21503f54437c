"""A paged places service as a Spark data source.

    spark.dataSource.register(PlacesDataSource)
    spark.read.format("places").option("baseUrl", ...).option("token", ...)
         .option("operation", "near-point").option("x", 139.7).option("y", 35.6).load()

Operations: near-point, within-extent, place-details, categories, category-details. Each
page names the next, so one search is one partition; many searches are many partitions
(option ``searches``, a JSON list of option objects). The token travels in a header and is
never part of an error or a plan.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructType, _parse_datatype_string

from .. import types

#: Fixed value of the service: the header that carries the token.
TOKEN_HEADER = "X-Esri-Authorization"

#: (url, headers) -> (status, body)
Fetch = Callable[[str, dict[str, str]], tuple[int, str]]

_SCHEMAS = {
    "near-point": types.PLACE_RESULT,
    "within-extent": types.EXTENT_RESULT,
    "place-details": types.PLACE_DETAILS,
    "categories": types.CATEGORY_DETAILS,
    "category-details": types.CATEGORY_DETAILS,
}


class PlacesError(RuntimeError):
    def __init__(self, status: int, error: dict):
        super().__init__(f"{error.get('code', status)}: {error.get('message', 'no message')} {' '.join(error.get('details') or [])}".strip())
        self.code, self.details = error.get("code", status), error.get("details")


@dataclass
class SearchParams:
    """Parameters of an operation, checked and encoded."""

    operation: str
    values: dict[str, str] = field(default_factory=dict)

    _REQUIRED = {"near-point": ("x", "y"), "within-extent": ("xmin", "ymin", "xmax", "ymax"), "place-details": ("placeId",), "categories": (), "category-details": ("categoryId",)}
    _OPTIONAL = {
        "near-point": ("radius", "categoryIds", "searchText", "pageSize", "offset", "icon"),
        "within-extent": ("categoryIds", "searchText", "pageSize", "offset", "icon"),
        "place-details": ("requestedFields", "icon"),
        "categories": ("filter", "icon", "language"),
        "category-details": ("icon", "language"),
    }
    _PATHS = {"near-point": "/places/near-point", "within-extent": "/places/within-extent", "place-details": "/places/{placeId}", "categories": "/categories", "category-details": "/categories/{categoryId}"}

    def __post_init__(self):
        if self.operation not in self._PATHS:
            raise ValueError(f"unknown operation {self.operation!r}")
        if missing := [n for n in self._REQUIRED[self.operation] if n not in self.values]:
            raise ValueError(f"{self.operation} needs {', '.join(missing)}")

    def url(self, base: str) -> str:
        in_path = [n for n in ("placeId", "categoryId") if f"{{{n}}}" in self._PATHS[self.operation]]
        path = self._PATHS[self.operation].format(**{n: quote(str(self.values[n]), safe="") for n in in_path})
        names = [n for n in (*self._REQUIRED[self.operation], *self._OPTIONAL[self.operation]) if n not in in_path and n in self.values]
        if self.operation == "place-details" and "requestedFields" not in self.values:
            query = {"requestedFields": "all"}
        else:
            query = {}
        query |= {n: self._text(self.values[n]) for n in names}
        return base.rstrip("/") + path + "?" + urlencode({**query, "f": "json"})

    @staticmethod
    def _text(value) -> str:
        return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def http_fetch(url: str, headers: dict[str, str]) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=60) as r:  # noqa: S310
            return r.status, r.read().decode()
    except HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def fetch_json(fetch: Fetch, url: str, token: str | None, retries: int = 3, wait_s: float = 0.5) -> dict:
    """One page. Errors in the body raise; server errors and broken connections are retried."""
    headers = {TOKEN_HEADER: f"Bearer {token}"} if token else {}
    for attempt in range(retries + 1):
        try:
            status, body = fetch(url, headers)
        except OSError:
            if attempt == retries:
                raise
        else:
            if status < 500 or attempt == retries:
                try:
                    found = json.loads(body)
                except ValueError as e:
                    raise PlacesError(status, {"message": f"not JSON: {body[:100]!r}"}) from e
                if "error" in found or status >= 400:
                    raise PlacesError(status, found.get("error", {}))
                return found
        time.sleep(wait_s * 2**attempt)
    raise AssertionError("unreachable")


def search_pages(fetch: Fetch, url: str, token: str | None, **retry) -> Iterator[dict]:
    """Pages until one names no next; an empty page does not end the search."""
    seen = set()
    while url:
        if url in seen:
            raise PlacesError(0, {"message": "a page names itself or an earlier one as next"})
        seen.add(url)
        page = fetch_json(fetch, url, token, **retry)
        yield page
        url = (page.get("pagination") or {}).get("nextUrl")


def _records(operation: str, page: dict) -> list[dict]:
    if operation in ("near-point", "within-extent"):
        return page.get("results") or []
    if operation == "place-details":
        return [page["placeDetails"]]
    return (page.get("categories") or []) if operation == "categories" else [page]


def to_row(value, kind: DataType):
    """JSON -> what the schema asks for; absent members are null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(to_row(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return [to_row(v, kind.elementType) for v in value]
    if isinstance(kind, DoubleType):
        return float(value)
    return int(value) if isinstance(kind, LongType) else value


@dataclass
class _Search(InputPartition):
    options: dict

    def __init__(self, options: dict):
        self.options = options


class PlacesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self):
        if "searches" in self.options:
            return [_Search(o) for o in json.loads(self.options["searches"])]
        return [_Search({})]

    def read(self, partition):
        options = {**self.options, **partition.options}
        by_case = {n.lower(): n for names in (*SearchParams._REQUIRED.values(), *SearchParams._OPTIONAL.values()) for n in names}
        values = {by_case[k.lower()]: v for k, v in options.items() if k.lower() in by_case}
        lower = {k.lower(): v for k, v in options.items()}
        operation = lower["operation"]
        fetch = _fetcher(lower.get("fetcher"))
        for page in search_pages(fetch, SearchParams(operation, values).url(lower["baseurl"]), lower.get("token"), retries=int(lower.get("retries", 3)), wait_s=float(lower.get("retrywait", 0.5))):
            for record in _records(operation, page):
                yield to_row(record, self.schema)


def _fetcher(name: str | None) -> Fetch:
    """module:function, for tests and for services behind another client."""
    if not name:
        return http_fetch
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class PlacesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "places"

    def schema(self):
        operation = {k.lower(): v for k, v in self.options.items()}.get("operation")
        if operation not in _SCHEMAS:
            raise ValueError(f"option operation is one of {', '.join(_SCHEMAS)}")
        return types.columns_of(_SCHEMAS[operation])

    def reader(self, schema):
        return PlacesReader(schema, self.options)


def schema_of(operation: str) -> StructType:
    return _parse_datatype_string(_SCHEMAS[operation])
