"""sparkloom: text-segment analytics expressed as Spark DataFrame plans."""
