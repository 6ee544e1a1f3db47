from checks.registry import query
from tabscout.operators import audit as a


def rules(name, tables, rule_list, sql):
    @query(name, sql)
    def build(t):
        return a.audit({n: getattr(t, n) for n in tables}, rule_list())


def row(rule, kind, table, where):
    return f"SELECT '{rule}' AS rule, '{kind}' AS kind, count(*) AS violations FROM {table} WHERE {where}"


def union(*rows):
    return "\nUNION ALL\n".join(rows)


rules("chk_enum", ["orders", "events", "conversations"], lambda: [
    a.one_of("orders", "o_orderstatus", ["F", "O"]), a.one_of("events", "event_type", ["click", "view", "purchase"]),
    a.one_of("conversations", "role", ["user", "assistant"])], union(
    row("orders.o_orderstatus in list", "enum", "orders", "o_orderstatus NOT IN ('F', 'O')"),
    row("events.event_type in list", "enum", "events", "event_type NOT IN ('click', 'view', 'purchase')"),
    row("conversations.role in list", "enum", "conversations", "role NOT IN ('user', 'assistant')")))

rules("chk_range", ["lineitem", "customer"], lambda: [
    a.in_range("lineitem", "l_discount", 0, 0.09), a.in_range("lineitem", "l_quantity", 2), a.in_range("customer", "c_acctbal", 0)], union(
    row("lineitem.l_discount range", "range", "lineitem", "l_discount < 0 OR l_discount > 0.09"),
    row("lineitem.l_quantity range", "range", "lineitem", "l_quantity < 2"), row("customer.c_acctbal range", "range", "customer", "c_acctbal < 0")))

rules("chk_order", ["lineitem"], lambda: [a.after("lineitem", "l_extendedprice", "l_partkey")],
      row("lineitem.l_extendedprice > l_partkey", "order", "lineitem", "l_extendedprice <= l_partkey"))

# Fixed value: the pattern of an e-mail address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"

rules("chk_regex", ["pages", "documents"], lambda: [
    a.matches("pages", "url", r"^HTTPS://[a-z0-9.-]+/[a-z]{2}/[0-9]+"), a.matches("documents", "text", EMAIL, needs="@")], union(
    row("pages.url pattern", "regex", "pages", r"NOT regexp_matches(url, '^HTTPS://[a-z0-9.-]+/[a-z]{2}/[0-9]+', 'i')"),
    row("documents.text pattern", "regex", "documents", r"NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}', 'i')")))


def unique_sql(name, table, columns, where="true"):
    return f"SELECT '{name}' AS rule, 'unique' AS kind, count(*) AS violations FROM (SELECT {columns} FROM {table} WHERE {where} GROUP BY ALL HAVING count(*) > 1)"


rules("chk_unique", ["orders", "documents", "conversations"], lambda: [
    a.Unique("orders", ("o_orderkey",)), a.Unique("orders", ("o_custkey", "o_orderdate")), a.Unique("documents", ("text",)),
    a.Unique("conversations", ("role",), "turn = 0")], union(
    unique_sql("orders.o_orderkey unique", "orders", "o_orderkey"), unique_sql("orders.o_custkey+o_orderdate unique", "orders", "o_custkey, o_orderdate"),
    unique_sql("documents.text unique", "documents", "text"), unique_sql("conversations.role unique", "conversations", "role", "turn = 0")))

rules("chk_notnull", ["events", "orders"], lambda: [
    a.not_null("events", "value"), a.not_null("events", "props"), a.not_null("orders", "o_orderdate")], union(
    row("events.value not null", "not_null", "events", "value IS NULL"), row("events.props not null", "not_null", "events", "props IS NULL"),
    row("orders.o_orderdate not null", "not_null", "orders", "o_orderdate IS NULL")))

rules("chk_fk", ["lineitem", "orders", "labels", "documents", "events", "customer"], lambda: [
    a.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), a.ForeignKey("labels", "doc_id", "documents", "doc_id"),
    a.ForeignKey("documents", "doc_id", "labels", "doc_id"), a.ForeignKey("events", "event_id", "customer", "c_custkey")], union(
    row("lineitem.l_orderkey -> orders.o_orderkey", "foreign_key", "lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    row("labels.doc_id -> documents.doc_id", "foreign_key", "labels", "doc_id NOT IN (SELECT doc_id FROM documents)"),
    row("documents.doc_id -> labels.doc_id", "foreign_key", "documents", "doc_id NOT IN (SELECT doc_id FROM labels)"),
    row("events.event_id -> customer.c_custkey", "foreign_key", "events", "event_id NOT IN (SELECT c_custkey FROM customer)")))
