"""weftwork: bulk style analytics and table operators as Spark DataFrame transforms."""
