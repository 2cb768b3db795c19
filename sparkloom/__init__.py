"""sparkloom: graph analytics and corpus processing expressed as Spark DataFrame plans."""
