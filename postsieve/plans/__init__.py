"""Plans over whole tables, and the registered queries with the SQL that checks them."""


def load():
    """The module that holds QUERIES and SQL, after all modules of queries have added theirs."""
    from postsieve.plans import case_queries, queries, scan_queries  # noqa: F401

    return queries
