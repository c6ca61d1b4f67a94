"""Queries of the log readers: entries are worded from the driver's tables, and the SQL tells what each was worded from."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.sources import log_text as L

from .relational import query
from .roles import table

_LINES = "l_orderkey * 8 + l_linenumber AS time, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(l_quantity AS INT) AS q, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS money"
B = L.BREAK


def code(kind: str, k: str):
    return F.concat(F.lit(f"{kind}-"), F.lpad((F.col(k) % 1000).cast("string"), 3, "0"))


def entries(spark, sf_dir):
    """The log: an entry for each order line, of a kind by its line number; some are worded in a way that no reader knows."""
    x = table(spark, sf_dir, "lineitem").selectExpr(*(e.strip() for e in _LINES.split(", ")))
    ship = F.concat(F.lit("Hull "), F.col("p"))
    shown = F.concat(ship, F.lit(" ("), code("SHP", "p"), F.lit(")"))
    dock = F.concat(F.lit("Dock "), F.col("s"))
    place = F.concat(F.lit("Sector "), F.col("s") % 10)
    odd = F.col("q") > 45
    title = (
        F.when(F.col("n") == 1, "Ship Repaired").when(F.col("n") == 2, F.concat(shown, F.lit(L.DESTROYED))).when(F.col("n") == 3, L.REWARD).when(F.col("n") == 4, L.FOUND)
        .when(F.col("n") == 5, F.concat(F.lit(L.BAILED), ship, F.when(odd, F.lit(" somewhere")).otherwise(F.concat(F.lit(" in sector "), place, F.lit(".")))))
        .when((F.col("n") == 6) & odd, F.lit("Received surplus from nobody")).when((F.col("n") == 6) & (F.col("q") % 2 == 0), F.concat(F.lit("Received surplus of "), F.col("q"), F.lit(",000 Credits from Manager "), F.col("s"), F.lit(".")))
        .when(F.col("n") == 6, F.concat(F.lit("Received surplus from "), dock, F.lit(" in "), place)).when(F.col("q") % 2 == 0, L.PIRATES).otherwise(L.POLICE)
    )
    last = F.concat(F.lit(f"{B}Response: "), F.when(F.col("q") % 3 == 0, "Comply").otherwise("Flee"))
    text = (
        F.when((F.col("n") == 1) & ~odd, F.concat(F.lit("ABC "), shown, F.lit(" finished repairing at station: "), dock, F.lit(" ("), code("DCK", "s"), F.lit("). They have paid 5 Cr.")))
        .when((F.col("n") == 2) & ~odd, F.concat(F.lit("Location: "), place, F.lit(f"{B}Commander: Chief (CHF-001)"), F.when(F.col("q") > 9, F.concat(F.lit(f"{B}Destroyed by: Raider "), F.col("o"))).otherwise("")))
        .when((F.col("n") == 3) & ~odd, F.concat(F.lit(f"Faction: Union{B}Station: "), dock, F.lit(f"{B}Sector: "), place, F.lit(f"{B}Credited To: Ships: "), shown, F.lit(", Wing ("), code("WNG", "o"), F.lit(f"){B}Bounty: 1 Cr"), F.when(F.col("q") % 2 == 0, f"{B}Reputation: +<1").otherwise(F.concat(F.lit(f"{B}Reputation: +"), F.col("q")))))
        .when((F.col("n") == 4) & ~odd, F.concat(dock, F.lit(" "), code("DCK", "s"), F.lit(" in "), place, F.lit(f"{B}Found abandoned ship "), ship, F.lit(" "), code("SHP", "p"), F.lit(f".{B}Response: Claim if possible")))
        .when((F.col("n") == 7) & ~odd & (F.col("q") % 2 == 0), F.concat(ship, F.lit(" "), code("SHP", "p"), F.lit(" in "), place, F.lit(f"{B}Accosted by Union pirate ship {B}XYZ Raider "), code("RDR", "o"), F.lit("."), last))
        .when((F.col("n") == 7) & ~odd, F.concat(ship, F.lit(" "), code("SHP", "p"), F.lit(" in "), place, F.lit(f"{B}Ordered by Union police to stop at once"), last))
    )
    return x.select("time", F.lit("upkeep").alias("category"), title.alias("title"), text.alias("text"), "money")


def base(n: int, more: str = "") -> str:
    return f"FROM (SELECT {_LINES} FROM lineitem) WHERE n = {n} AND q <= 45{more}"


def sql_code(kind: str, k: str) -> str:
    return f"'{kind}-' || lpad(({k} % 1000)::VARCHAR, 3, '0')"


def services(log):
    return L.services(log, "Ship Repaired", " finished repairing at station: ", "repair")


def sectors(spark):
    return spark.range(9).select(F.concat(F.lit("s"), F.col("id")).alias("sector"), F.concat(F.lit("Sector "), F.col("id")).alias("name"))


def parties(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    managers = s.select(F.concat(F.lit("Manager "), F.col("s_suppkey")).alias("manager_name"), F.col("s_suppkey").alias("manager_id"))
    stations = s.select((F.col("s_suppkey") + 1000).alias("station_id"), code("DCK", "s_suppkey").alias("code"), F.concat(F.lit("Dock "), F.col("s_suppkey")).alias("name"), F.col("s_suppkey").alias("manager_id"))
    return managers, stations


@query(f"SELECT time, money // 100 AS money, 'Dock ' || s AS seller_name, {sql_code('DCK', 's')} AS seller_code, 1 AS amount, 'repair' AS commodity, 'ABC' AS buyer_faction, 'Hull ' || p AS buyer_name, {sql_code('SHP', 'p')} AS buyer_code {base(1)}")
def dom11_services(spark, sf_dir):
    return services(entries(spark, sf_dir))[0]


@query(f"SELECT time, 'Hull ' || p || ' (' || {sql_code('SHP', 'p')} || ')' AS object, 'Sector ' || s % 10 AS location, CASE WHEN q > 9 THEN 'Raider ' || o END AS killer {base(2)}")
def dom12_destroyed(spark, sf_dir):
    return L.destroyed(entries(spark, sf_dir))[0]


@query(f"SELECT time, 'Union' AS faction, 'Dock ' || s AS station, 'Sector ' || s % 10 AS sector, 'ship' AS kind, money / 100.0 AS bounty, CASE WHEN q % 2 = 0 THEN 0.5 ELSE q END::DOUBLE AS reputation, unnest([1, 2])::INT AS nth, unnest(['Hull ' || p, 'Wing']) AS name, unnest([{sql_code('SHP', 'p')}, {sql_code('WNG', 'o')}]) AS code {base(3)}")
def dom13_rewards(spark, sf_dir):
    return L.rewards(entries(spark, sf_dir))[0]


@query(f"SELECT time, 'Dock ' || s AS finder, {sql_code('DCK', 's')} AS finder_code, 'Sector ' || s % 10 AS sector, 'Hull ' || p AS claimed, {sql_code('SHP', 'p')} AS claimed_code {base(4)}")
def dom14_claims(spark, sf_dir):
    return L.claims(entries(spark, sf_dir))[0]


@query(f"SELECT time, 'Hull ' || p AS ship, 'Sector ' || s % 10 AS sector {base(5)}")
def dom15_bails(spark, sf_dir):
    return L.bails(entries(spark, sf_dir))[0]


@query(f"SELECT time, CASE WHEN q % 2 = 0 THEN q * 1000 ELSE money / 100.0 END::DOUBLE AS money, s + 1000 AS station_id, {sql_code('DCK', 's')} AS station_code, 'Dock ' || s AS station_name {base(6)}")
def dom16_transfers(spark, sf_dir):
    return L.transfers(entries(spark, sf_dir), *parties(spark, sf_dir))[0]


@query(f"SELECT time, 'Hull ' || p AS ship_name, {sql_code('SHP', 'p')} AS ship_code, CASE WHEN s % 10 < 9 THEN 's' || s % 10 END AS sector, 'Sector ' || s % 10 AS sector_name, 'Raider' AS pirate_name, {sql_code('RDR', 'o')} AS pirate_code, 'XYZ' AS pirate_faction, CASE WHEN q % 3 = 0 THEN 'Comply' ELSE 'Flee' END AS response {base(7, ' AND q % 2 = 0')}")
def dom17_pirates(spark, sf_dir):
    return L.pirates(entries(spark, sf_dir), sectors(spark))[0]


@query(f"SELECT time, 'Hull ' || p AS ship_name, {sql_code('SHP', 'p')} AS ship_code, CASE WHEN s % 10 < 9 THEN 's' || s % 10 END AS sector, 'Sector ' || s % 10 AS sector_name, 'UNI' AS police_faction, CASE WHEN q % 3 = 0 THEN 'Comply' ELSE 'Flee' END AS response {base(7, ' AND q % 2 = 1')}")
def dom18_police(spark, sf_dir):
    return L.police(entries(spark, sf_dir), sectors(spark), spark.createDataFrame([("Union", "UNI")], "name string, short string"))[0]


@query("SELECT CASE l_linenumber WHEN 1 THEN 'services' WHEN 2 THEN 'destroyed' WHEN 3 THEN 'reward' WHEN 4 THEN 'claim' WHEN 5 THEN 'bail' WHEN 6 THEN 'transfer' ELSE CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'pirates' ELSE 'police' END END AS kind, count(*) AS n FROM lineitem WHERE CAST(l_quantity AS INT) > 45 GROUP BY ALL")
def dom19_unread(spark, sf_dir):
    log, s = entries(spark, sf_dir), sectors(spark)
    read = [services(log), L.destroyed(log), L.rewards(log), L.claims(log), L.bails(log), L.transfers(log, *parties(spark, sf_dir)), L.pirates(log, s), L.police(log, s, spark.createDataFrame([], "name string, short string"))]
    return L.report([bad for _, bad in read]).select("kind", "n")
