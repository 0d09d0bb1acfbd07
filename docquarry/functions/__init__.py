"""Column builders; everything here stays inside Catalyst."""
