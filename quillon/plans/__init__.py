"""Views over the fixture tables, and the registered queries with their SQL."""
