"""Column -> Column builders."""
