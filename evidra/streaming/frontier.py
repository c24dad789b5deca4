"""Best-first search over pages as they arrive: a host's search is keyed state, and each page that it takes next goes out once.

Pages come in any order and in any batches. One that the search has not asked for yet waits in the host's state; one that it asks for
and that is there, or that can no longer come, lets it take the next turn. So the order of the visits is that of frontier.best_first()
over the same pages, whenever they arrive. Needs a RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evidra.operators import frontier
from evidra.sources.commits import Commits

#: The state store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = f"host string, url string, end string, offers {frontier.OFFERS}"
VISITS = "host string, url string, priority int, depth int, page_no int"


class Search(StatefulProcessor):
    """The search of one host. Its row holds at most seen URLs; pages that are not asked for yet are a map beside it."""

    def __init__(self, max_pages: int, max_depth: int, seen: int):
        self.max_pages, self.max_depth, self.seen = max_pages, max_depth, seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.search = handle.getValueState("search", "state string")
        self.waiting = handle.getMapState("waiting", "url string", "end string, offers string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        host = key[0]
        if self.search.exists():
            now = json.loads(self.search.get()[0])
        else:
            root = f"https://{host}/"
            now = {"host": host, "queue": [{"priority": 0, "depth": 0, "url": root}], "known": [root], "visited": [], "spare": True, "pages": [], "at": None, "depth": None, "spent": 0.0, "closed": False, "begun": False}
        for r in rows:
            if r.url is None:
                now["closed"] = True
            elif r.url not in now["visited"] or r.url == now["at"]:
                offers = [{"url": o["url"], "priority": o["priority"]} for o in r.offers or []]
                if not self.waiting.containsKey((r.url,)):
                    self.waiting.updateValue((r.url,), (r.end, json.dumps(offers)))
        while len(now["pages"]) < self.max_pages:
            offers = None
            if now["begun"]:
                if now["at"] is None:
                    break
                if self.waiting.containsKey((now["at"],)):
                    end, said = self.waiting.getValue((now["at"],))
                    self.waiting.removeKey((now["at"],))
                    offers, now["at"] = json.loads(said), end or now["at"]
                elif not now["closed"]:
                    break
            now |= frontier.turned(now | {"offers": offers}, self.max_depth, self.seen) | {"begun": True}
            if now["at"] is not None:
                best = now["pages"][-1]
                yield Row(host=host, url=best["url"], priority=best["priority"], depth=best["depth"], page_no=len(now["pages"]))
        self.search.update((json.dumps(now),))

    def close(self) -> None:
        pass


def visits(events: DataFrame, max_pages: int = 8, max_depth: int = 2, seen: int = frontier.SEEN) -> DataFrame:
    """VISITS of a stream of EVENTS: a page's canonical url, the end it leads to, or null, and the links that it offers (frontier.OFFERS).

    An event without url says that no more pages of its host come: what its search still asks for counts as without links.
    """
    return events.groupBy("host").transformWithState(Search(max_pages, max_depth, seen), VISITS, "append", "none")


def searched(events: DataFrame, batches: int = 3, **how) -> DataFrame:
    """VISITS of a table of events, read as a stream in so many batches by hash of the URL; the last one says that no more pages come.

    Events, visits and the state's checkpoint are in the shared folder.
    """
    spark, commits = events.sparkSession, Commits(events.sparkSession)
    last = events.select("host").distinct().select("host", *(F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), ("end", "string"), ("offers", frontier.OFFERS))))
    dealt = events.withColumn("batch", F.pmod(F.xxhash64("url"), F.lit(batches))).unionByName(last.withColumn("batch", F.lit(batches).cast("long")))
    dealt = commits.step("dealt", dealt)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STORE)
    try:
        for b in range(batches + 1):
            dealt.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{commits.root}/events")
            # Every start takes the new files as the next batch and goes on with the state of the ones before.
            stream = spark.readStream.schema(EVENTS).parquet(f"{commits.root}/events")
            q = visits(stream, **how).writeStream.format("parquet").option("path", f"{commits.root}/visits").option("checkpointLocation", f"{commits.root}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(VISITS).parquet(f"{commits.root}/visits")
