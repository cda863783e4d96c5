"""shelfline: retail sales and stock analytics as Spark jobs.

Two facts (``sales`` lines, daily ``inventory``) and three dimensions
(``store``, ``product``, ``calendar``) go in; a day table, a week mart with
thirteen metrics, landing audits and snapshots come out.  Every step is a
``DataFrame -> DataFrame`` function; Spark plans and runs all of it.
"""

__version__ = "0.1.0"
