"""hopweave: knowledge graphs and multi-hop retrieval over document tables, as DataFrame plans."""
