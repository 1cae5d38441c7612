"""Writers: quarantine, receipts, audit, snapshots, copies, catalog upserts."""
