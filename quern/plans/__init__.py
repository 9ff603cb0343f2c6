"""Plans: every reference operator as a query with the SQL it has to agree with."""
