"""The little of a DB-API that tests need, over the session's JVM: Derby is an embedded database, so only that JVM can open it."""

from py4j.java_gateway import GatewayParameters, JavaGateway


class Derby:
    """connect() for polling.DatabaseTable; picklable, and usable in the Python workers of a local session."""

    def __init__(self, spark, url):
        parameters = spark.sparkContext._gateway.gateway_parameters
        self.port, self.token, self.url = parameters.port, parameters.auth_token, url
        self.log = None  # a file that takes a line for each write

    def __call__(self):
        gateway = JavaGateway(gateway_parameters=GatewayParameters(port=self.port, auth_token=self.token, auto_convert=True))
        return Connection(gateway, gateway.jvm.java.sql.DriverManager.getConnection(self.url), self.log)


class Connection:
    def __init__(self, gateway, inner, log):
        self.gateway, self.inner, self.log = gateway, inner, log
        inner.setAutoCommit(False)

    def cursor(self):
        return Cursor(self.inner, self.log)

    def commit(self):
        self.inner.commit()

    def rollback(self):
        self.inner.rollback()

    def close(self):
        self.inner.rollback()
        self.inner.close()
        self.gateway.close()


class Cursor:
    def __init__(self, inner, log):
        self.inner, self.log = inner, log

    def _prepared(self, sql, values):
        statement = self.inner.prepareStatement(sql)
        for i, value in enumerate(values, 1):
            statement.setString(i, value.isoformat(" ")) if hasattr(value, "isoformat") else statement.setObject(i, value)
        return statement

    def execute(self, sql, values=()):
        statement = self._prepared(sql, values)
        self.rows = statement.getResultSet() if statement.execute() else None

    def executemany(self, sql, rows):
        if self.log:
            with open(self.log, "a") as out:
                out.write(f"{len(rows)}\n")
        for values in rows:
            self._prepared(sql, values).executeUpdate()

    def fetchmany(self, n):
        from datetime import datetime

        out, meta = [], self.rows.getMetaData()
        while len(out) < n and self.rows.next():
            row = []
            for i in range(1, meta.getColumnCount() + 1):
                value = self.rows.getString(i) if meta.getColumnTypeName(i) in ("TIMESTAMP", "CLOB") else self.rows.getObject(i)
                row.append(datetime.fromisoformat(value) if value is not None and meta.getColumnTypeName(i) == "TIMESTAMP" else value)
            out.append(tuple(row))
        return out


def refused(error):
    """Whether Derby's state says that rows were at fault."""
    return "ConstraintViolation" in str(error) or "truncation error" in str(error)
