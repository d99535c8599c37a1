"""One call for all sources: look a connection up in the catalog and read a query from it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, InvalidRequest, NotFound, SecretNotFound, SourceUnavailable
from .operators import catalog, codes, postings, search, vector
from .sources import export, files, jdbc, sqlite, sqltext


class Connection:
    """A resolved connection: its properties, its secret and the provider of its type."""

    def __init__(self, provider: str, properties: Mapping[str, str], secret: Mapping[str, str]) -> None:
        self.provider = provider
        self.properties = dict(properties or {})
        self.secret = dict(secret or {})

    def setting(self, *names: str) -> str | None:
        """A property, else a secret entry; names are tried in order and in any case."""
        for source in (self.properties, self.secret):
            lowered = {k.lower(): v for k, v in source.items()}
            for name in names:
                if name in lowered:
                    return lowered[name]
        return None

    def names(self, spark: SparkSession, wanted: str) -> list[str]:
        """A comma list of table names; ``*`` stands for registered tables."""
        names = []
        for name in (n.strip() for n in wanted.split(",")):
            if "*" not in name:
                names.append(name)
            elif (location := self.setting("location")) is not None:
                names += files.names_at(spark, location, name)
            else:
                names += sorted(t.name for t in spark.catalog.listTables() if fnmatchcase(t.name, name))
        if not names:
            raise NotFound(f"no index matches '{wanted}'")
        return names

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A named table of the connection: a file under ``location``, or a registered table."""
        location = self.setting("location")
        if location is None:
            return spark.table(name)
        return files.read_object(spark, location.replace("{name}", name), self.properties.get("format"))


class Hub:
    """Reads queries through connections kept in document tables.

    ``connections`` and ``types`` are document tables. ``secrets`` is ``(name, namespace,
    properties)``. Every lookup fetches one row by its key.
    """

    def __init__(
        self,
        spark: SparkSession,
        connections: DataFrame,
        types: DataFrame,
        tenant: str,
        global_tenant: str = "global",
        secrets: DataFrame | None = None,
    ) -> None:
        self.spark = spark
        self.connections = connections
        self.types = types
        self.tenant = tenant
        self.global_tenant = global_tenant
        self.secrets = secrets
        self._readers: dict[str, Callable[[str, Connection, Any, bool], DataFrame]] = {
            "postgres": self._read_sql_server,
            "sqlite": self._read_sqlite,
            "s3": self._read_object,
            "elasticsearch": self._read_search,
            "milvus": self._read_vectors,
            "neo4j": self._read_graph,
        }

    # -- lookup --------------------------------------------------------------------------------

    def connection(self, connection_id: str) -> Connection:
        """Resolve id -> connection -> type -> provider, and the referenced secret."""
        own = (F.col(catalog.ID) == connection_id) & (F.col(catalog.TENANT) == self.tenant)
        found = self.connections.where(own).select("resource").first()
        if found is None:
            raise NotFound(f"no connection '{connection_id}'")
        resource = found["resource"]
        visible = (F.col(catalog.ID) == resource["data_connection_type_id"]) & catalog.visible_to(
            self.types, self.tenant, self.global_tenant
        )
        kind = self.types.where(visible).select("resource.provider").first()
        if kind is None:
            raise NotFound(f"no connection type '{resource['data_connection_type_id']}'")
        if kind["provider"] not in self._readers:
            raise ConfigError(f"provider '{kind['provider']}' is not supported")
        return Connection(kind["provider"], resource["properties"], self._secret(resource))

    def _secret(self, resource: Any) -> Mapping[str, str]:
        admin = resource["admin"] if "admin" in resource else None
        if not admin:
            return {}
        if "secret" in admin and admin["secret"]:
            return admin["secret"]
        reference = admin["secret_ref"]
        if reference is None:
            return {}
        row = None
        if self.secrets is not None:
            mine = (F.col("name") == reference) & (F.col("namespace") == self.tenant)
            row = self.secrets.where(mine).select("properties").first()
        if row is None:
            raise SecretNotFound(f"no secret '{reference}'")
        return row["properties"]

    # -- the catalog ---------------------------------------------------------------------------

    def list_connections(self) -> DataFrame:
        """The tenant's connections, one flat row each, with their ``total_count``."""
        listed = catalog.tenant_list(self.connections, self.tenant)
        if "status" in listed.columns:
            listed = catalog.with_default_status(listed)
        return catalog.flatten_envelope(listed, {"tenant_id": F.lit("")})

    def list_types(self) -> DataFrame:
        """The types the tenant may use; shared ones show an empty tenant."""
        seen = catalog.global_visibility(self.types, self.tenant, self.global_tenant)
        return catalog.flatten_envelope(seen, {"tenant_id": F.lit("")})

    # -- reading -------------------------------------------------------------------------------

    def read(
        self, query: str, connection_id: str, parameters: Mapping[str, Any] | Sequence[Any] | None = None
    ) -> DataFrame:
        """The rows of a query. What the text means depends on the connection's provider.

        SQL for ``postgres`` and ``sqlite``, an object path for ``s3``, a JSON body for
        ``elasticsearch`` and ``milvus``, Spark SQL over ``nodes`` and ``edges`` for ``neo4j``. The
        result is lazy, but a search with a small limit finds its keys at once.
        """
        return self._frame(query, connection_id, parameters, late=True)

    def _frame(self, query: str, connection_id: str, parameters: Any, late: bool) -> DataFrame:
        connection = self.connection(connection_id)
        return self._readers[connection.provider](query, connection, parameters, late)

    def read_pandas(self, query: str, connection_id: str, parameters: Any = None):
        """The result as a pandas frame on the driver; for results known to be small."""
        return self.read(query, connection_id, parameters).toPandas()

    def read_batches(
        self, query: str, connection_id: str, parameters: Any = None, batch_size: int = export.DEFAULT_BATCH
    ) -> Iterator[pa.RecordBatch]:
        """The result as Arrow batches, one partition at a time."""
        return export.iter_batches(self.read(query, connection_id, parameters), batch_size)

    def describe(self, query: str, connection_id: str, parameters: Any = None) -> DataFrame:
        """Columns of a query's result; the query does not run."""
        return sqltext.describe_query(self._frame(query, connection_id, parameters, late=False))

    def _read_sql(self, query: str, connection: Connection, parameters: Any) -> DataFrame:
        """SQL text over tables kept as files: ``location`` and a comma list of ``tables``."""
        names = [t.strip() for t in connection.properties.get("tables", "").split(",") if t.strip()]
        location = connection.properties["location"]
        tables = {name: self.spark.read.parquet(location.replace("{name}", name)) for name in names}
        return sqltext.sql_read(self.spark, query, parameters, tables)

    def _read_sql_server(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        if "location" in connection.properties:
            return self._read_sql(query, connection, parameters)
        if parameters:
            raise InvalidRequest("parameters are bound by Spark SQL, not by a database read over JDBC")
        url = connection.setting("url", "uri")
        if url is None:
            raise SourceUnavailable("the connection has no database url")
        return jdbc.read_jdbc(self.spark, url, query, **_ranges(connection))

    def _read_sqlite(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        if "location" in connection.properties:
            return self._read_sql(query, connection, parameters)
        if parameters:
            raise InvalidRequest("parameters are bound by Spark SQL, not by a SQLite read")
        url = connection.setting("url")
        if url is None:
            raise SourceUnavailable("the connection has no url of a SQLite file")
        ranges = _ranges(connection)
        return sqlite.read_sqlite(self.spark, url, query, ranges["partition_column"], ranges["num_partitions"] or 1)

    def _read_object(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        root = connection.setting("location", "root")
        path = query if root is None else f"{root.rstrip('/')}/{query.lstrip('/')}"
        return files.read_object(self.spark, path, connection.properties.get("format"))

    def _read_search(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        request = search.parse_search(query)
        wanted = search.resolve_default_index(request.index, connection.properties)
        frames = [connection.table(self.spark, name) for name in connection.names(self.spark, wanted)]
        id_field = connection.properties.get("id_field", "id")
        mapping = connection.properties.get("mapping")
        if mapping is not None:
            doc = connection.properties.get("doc_field", "doc")
            frames = [_typed_documents(frame, doc, json.loads(mapping), id_field) for frame in frames]
        index = frames[0] if len(frames) == 1 else search.merge_schemas(frames)
        stored = connection.setting("text_index_location")
        served = postings.open_text_index(self.spark, stored.replace("{name}", wanted)) if stored else None
        return search.search(index, request, id_field, late, served)

    def _read_vectors(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        request = vector.parse_vector_request(query)
        collection = connection.table(self.spark, request.collection)
        key = connection.properties.get("primary_key", "id")
        cells, coded, index = connection.setting("index_location"), connection.setting("code_index_location"), None
        if request.operation == "search" and (cells or coded):
            opened = vector.open_cell_index if cells else codes.open_code_index
            index = opened(self.spark, (cells or coded).replace("{name}", request.collection))
        return vector.vector_dispatch(collection, request, key, connection.properties.get("metric", "L2"), late, index)

    def _read_graph(self, query: str, connection: Connection, parameters: Any, late: bool) -> DataFrame:
        tables = {name: connection.table(self.spark, name) for name in ("nodes", "edges")}
        return sqltext.sql_read(self.spark, query, parameters, tables)


def _typed_documents(index: DataFrame, doc: str, mapping: Mapping[str, Any], id_field: str) -> DataFrame:
    """An index kept as JSON text, typed by its mapping; the id is a mapped field or a column of its own."""
    mapped = {path for path, _ in search.parse_mapping(mapping)}
    return search.documents(index, doc, mapping, [] if id_field in mapped else [id_field])


def _ranges(connection: Connection) -> dict[str, Any]:
    """Parallel range reads, if the connection names a column for them."""
    pieces = connection.properties.get("num_partitions")
    return {
        "partition_column": connection.properties.get("partition_column"),
        "num_partitions": int(pieces) if pieces else None,
    }
