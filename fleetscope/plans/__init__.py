"""Plans: order-aware window helpers, fixture views, and the registered queries."""
