"""DataFrame operators, one module per detector plus the shared ordered scan."""
