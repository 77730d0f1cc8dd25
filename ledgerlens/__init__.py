"""ledgerlens: company-report analytics expressed as Spark DataFrame and SQL plans."""
