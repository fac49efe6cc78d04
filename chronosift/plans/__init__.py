"""The event table and the queries built from it."""


def all_queries():
    from chronosift.plans import catalog, source_catalog  # noqa: F401
    return dict(catalog.QUERIES)


def all_oracles():
    from chronosift.plans import catalog, source_catalog  # noqa: F401
    return dict(catalog.ORACLES)
