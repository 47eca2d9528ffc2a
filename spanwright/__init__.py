"""spanwright: distributional grammar induction and corpus analytics on PySpark."""
