"""Column-expression helpers.  Everything here returns a ``Column`` built from
``pyspark.sql.functions``; nothing leaves the JVM."""
