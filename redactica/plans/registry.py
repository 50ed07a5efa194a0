"""All queries of the library, from the modules that hold them."""

from redactica.plans import further, more, queries, scale

MODULES = (queries, more, further, scale)
QUERIES = queries.QUERIES
SQL = queries.SQL
