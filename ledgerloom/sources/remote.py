"""Another program's lists, page by page, as a data source: each task reads a range of pages with a token of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.session import ship, ship_code

#: Keys below which a list may stand in an answer.
WRAPPERS = ("items", "data", "clients", "results")

#: The lists that the ledger looks things up in.
CLIENTS = "id string, full_name string, phone string"
CONTRACTS = "id string, branch_id string, number long, product_name string, remaining long"
PAYMENTS = "amount long, paid_at timestamp"


class Unauthorized(Exception):
    """The token isn't valid, or no longer."""


@dataclass
class Pages(InputPartition):
    """Pages from ``first`` to before ``last``; the open one goes on until a page isn't full."""

    first: int
    last: int
    open: bool


def items(body: str | bytes) -> list[dict]:
    """The objects of a list, bare or below one of the usual keys; an answer without one has none."""
    try:
        found = json.loads(body)
    except ValueError:
        return []
    if isinstance(found, dict):
        found = next((found[k] for k in WRAPPERS if isinstance(found.get(k), list)), [])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


class _Session:
    """Asks for pages; renews the token once for a page that is refused."""

    def __init__(self, fetch, login, limit: int):
        self.fetch, self.login, self.limit, self.token = fetch, login, limit, None

    def page(self, n: int) -> list[dict]:
        for _ in range(2):
            if self.token is None:
                self.token = self.login()
            try:
                return items(self.fetch(n, self.limit, self.token))
            except Unauthorized:
                self.token = None
        raise Unauthorized(f"page {n} is refused with a new token")


def _pages(session: _Session) -> int:
    """How many pages there are: the first empty one, by doubling and halving."""
    if not session.page(0):
        return 0
    full, empty = 0, 1
    while session.page(empty):
        full, empty = empty, 2 * empty
    while empty - full > 1:
        half = (full + empty) // 2
        full, empty = (half, empty) if session.page(half) else (full, half)
    return empty


def paged(spark: SparkSession, name: str, schema: str, fetch: Callable[[int, int, str], str | bytes], login: Callable[[], str], limit: int = 200, tasks: int = 8, key: str | None = "id") -> DataFrame:
    """A table of all items of a paged list.

    ``fetch`` (page from 0, limit, token) gives a page's answer as JSON or raises ``Unauthorized``; ``login`` gives a token. Both
    go to the executors. A refused page is asked for again with a new token, once. Values that aren't of the schema's type
    are null, and items without a ``key`` are left out. Pages are counted on the driver, by a few requests, and dealt to
    ``tasks``; pages that come while it reads are read by the last one. ``name`` is the format's, in this session.
    """
    ship(spark)
    ship_code(__name__)

    class Reader(DataSourceReader):
        def partitions(self) -> list[Pages]:
            n = _pages(_Session(fetch, login, limit))
            cuts = sorted({n * i // tasks for i in range(tasks + 1)} | {0, n})
            ranges = list(zip(cuts, cuts[1:], strict=False)) or [(0, 0)]
            return [Pages(a, b, b == n) for a, b in ranges]

        def read(self, partition: Pages) -> Iterator[tuple]:
            session, n = _Session(fetch, login, limit), partition.first
            while n < partition.last or partition.open:
                found = session.page(n)
                for item in found:
                    yield (json.dumps(item, ensure_ascii=False),)
                if n >= partition.last and len(found) < limit:
                    return
                n += 1

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "item string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    rows = spark.read.format(name).load().select(F.from_json("item", schema).alias("x")).select("x.*")
    return rows.filter(F.col(key) != "") if key else rows
