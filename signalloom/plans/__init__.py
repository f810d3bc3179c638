"""Views over the test tables, whole flows, and the registered queries with their SQL."""
