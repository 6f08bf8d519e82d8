"""Rows that the sample files must give: column names and types, and the rows."""

ROWS = {
    "parse_grant_gen1": (
        "patnum VARCHAR, pubdate VARCHAR, appnum VARCHAR, appdate VARCHAR, ipc VARCHAR, ipcver VARCHAR, city VARCHAR, state VARCHAR, country VARCHAR, owner VARCHAR, claims BIGINT, title VARCHAR, abstract VARCHAR, gen BIGINT, file VARCHAR",
        [
            ('3930584', '19760106', '05123456', '19740101', 'a61b051/2', '2', 'paris', 'ca', 'us', 'second corp', 12, 'widget andmaker', 'one\ntwo', 1, 'a.dat'),
            ('d238976', '19760106', '29765432', None, None, None, None, None, None, None, None, None, None, 1, 'a.dat'),
        ],
    ),
    "parse_grant_gen2": (
        "patnum VARCHAR, pubdate VARCHAR, appnum VARCHAR, appdate VARCHAR, ipc VARCHAR, ipcver VARCHAR, city VARCHAR, state VARCHAR, country VARCHAR, owner VARCHAR, claims BIGINT, title VARCHAR, abstract VARCHAR, gen BIGINT, file VARCHAR",
        [
            ('6167569', '20010102', '09123456', '19990101', 'a41d013/00', '7', None, None, None, None, 3, 'coat — long', 'first\nsecond', 2, 'pgb1.xml'),
        ],
    ),
    "parse_grant_gen3": (
        "patnum VARCHAR, pubdate VARCHAR, appnum VARCHAR, appdate VARCHAR, ipc VARCHAR, ipcver VARCHAR, city VARCHAR, state VARCHAR, country VARCHAR, owner VARCHAR, claims BIGINT, title VARCHAR, abstract VARCHAR, gen BIGINT, file VARCHAR",
        [
            ('10000001', '20180619', '14000001', '20150101', 'g06f009/44', '20060101', 'rome', None, 'it', 'second corporation', 20, 'fast', 'hello world', 3, 'ipgb1.xml'),
            ('7000001', '20060214', '10000777', '20030101', 'f16h010/0', '07', 'boise', 'id', 'us', 'acme gears ltd.', None, 'gear & shaft é', None, 3, 'ipgb2.xml'),
            ('re40001', '20060214', None, None, None, None, None, None, None, None, None, None, None, 3, 'ipgb2.xml'),
        ],
    ),
    "parse_grant_classes": (
        "patnum VARCHAR, ipc VARCHAR, rank BIGINT, version VARCHAR",
        [
            ('10000001', 'g06f009/44', 0, '20060101'),
            ('3930584', 'a61b', 1, '2'),
            ('3930584', 'a61b051/2', 0, '2'),
            ('6167569', 'a41d013/00', 0, '7'),
            ('6167569', 'a41d027/00', 1, '7'),
            ('7000001', 'F16H057/04', 1, '07'),
            ('7000001', 'f16h010/0', 0, '07'),
        ],
    ),
    "parse_grant_cites": (
        "src VARCHAR, dst VARCHAR",
        [
            ('10000001', '6167569'),
            ('3930584', '3000001'),
            ('3930584', 'd200002'),
            ('6167569', '2761147'),
            ('7000001', 'd400001'),
        ],
    ),
    "parse_applications": (
        "appnum VARCHAR, appdate VARCHAR, appname VARCHAR, pubnum VARCHAR, pubdate VARCHAR, ipc VARCHAR, ipcver VARCHAR, city VARCHAR, state VARCHAR, country VARCHAR, title VARCHAR, abstract VARCHAR, gen BIGINT, file VARCHAR",
        [
            ('09500001', '20000201', 'second corp.', '20010000001', '20010315', 'b01d 3', '7', 'oslo', None, 'no', 'still', None, 2, 'pab1.xml'),
            ('09500002', '20000301', None, '20010000002', '20010322', 'g01n 33', '7', 'reno', 'nv', 'us', 'probe', 'some text', 2, 'pab2.xml'),
            ('11000002', '20050101', None, '20060000002', '20060105', 'f04b 100', '7', 'lyon', None, 'fr', 'pump', 'one two', 3, 'ipab2.xml'),
            ('15000001', '20170101', 'zyx gmbh', '20190000001', '20190103', None, None, 'ulm', None, 'de', 'rig', None, 3, 'ipab1.xml'),
        ],
    ),
    "parse_application_classes": (
        "patnum VARCHAR, ipc VARCHAR, rank BIGINT, version VARCHAR",
        [
            ('09500001', 'b01d 3', 0, '7'),
            ('09500002', 'c12q 168', 1, '7'),
            ('09500002', 'g01n 33', 0, '7'),
            ('11000002', 'f04b 100', 0, '7'),
        ],
    ),
    "parse_transfers": (
        "assignid VARCHAR, bulkid VARCHAR, patnum VARCHAR, execdate VARCHAR, recdate VARCHAR, conveyance VARCHAR, assignor VARCHAR, assignee VARCHAR, assignee_state VARCHAR, assignee_country VARCHAR, gen BIGINT, file VARCHAR",
        [
            ('1234007_0', '1234007', '10000001', '20100101', '20100202', 'assignment of assignors interest', 'second corp', 'zyx gmbh', None, 'united states', 3, 'ad.xml'),
            ('1234007_1', '1234007', '6167569', '20100101', '20100202', 'assignment of assignors interest', 'second corp', 'zyx gmbh', None, 'united states', 3, 'ad.xml'),
        ],
    ),
    "parse_trademarks": (
        "serial VARCHAR, regdate VARCHAR, filedate VARCHAR, n_stat BIGINT, gs_codes VARCHAR, statement VARCHAR, us_class VARCHAR, int_class VARCHAR, owners VARCHAR, file VARCHAR",
        [
            ('70000001', None, '18840407', 1, 'gs0011', 'tea', '046; 047', '030', 'tea co', 'apc1.xml'),
            ('70000002', '18840506', None, 2, 'gs0301; gs0302', 'oil; soap', None, None, 'b co; a co', 'apc2.xml'),
        ],
    ),
    "scan_fixed_width": (
        "patnum VARCHAR, is_small VARCHAR, event_code VARCHAR",
        [
            ('10000001', 'Y', 'EXP.'),
            ('1111111', 'Y', 'M170'),
            ('6167569', 'N', 'M172'),
            ('6167569', 'Y', 'M2551'),
            ('9999999', 'Y', 'M170'),
            ('re350001', 'N', 'M183'),
        ],
    ),
    "latest_maintenance": (
        "patnum VARCHAR, last_maint INTEGER, ever_large BOOLEAN",
        [
            ('6167569', 12, True),
        ],
    ),
    "parse_accounts": (
        "name VARCHAR, gvkey BIGINT, year BIGINT, naics VARCHAR, sic VARCHAR, assets DOUBLE, capx DOUBLE, cash DOUBLE, cogs DOUBLE, deprec DOUBLE, income DOUBLE, employ DOUBLE, intan DOUBLE, debt DOUBLE, revenue DOUBLE, sales DOUBLE, rnd DOUBLE, fcost DOUBLE, mktval DOUBLE, compid BIGINT",
        [
            ('acme inc', 101, 2019, '3344135', '000000', 7.5, None, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1),
            ('zyx gmbh', 100, 2018, '334000', '357000', 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, 1.0, 6.0, 0),
        ],
    ),
    "files_by_format": (
        "file VARCHAR, place BIGINT, n_records BIGINT, n_bad BIGINT",
        [
            ('a.dat', 0, 2, 0),
            ('ipgb1.xml', 1, 1, 0),
            ('ipgb2.xml', 2, 2, 0),
            ('pgb1.xml', 3, 1, 1),
        ],
    ),
    "quarantined": (
        "file VARCHAR, error VARCHAR",
        [
            ('pgb1.xml', 'ParseError'),
        ],
    ),
    "parse_new_files": (
        "step VARCHAR, n_files BIGINT, n_rows BIGINT, n_patents BIGINT",
        [
            ('again', 0, 3, 3),
            ('dry', 1, 3, 3),
            ('first', 2, 3, 3),
            ('new', 1, 5, 5),
            ('overwrite', 3, 5, 5),
        ],
    ),
    "dispatch_sources": (
        "kind VARCHAR, name VARCHAR, n_rows BIGINT",
        [
            ('apply', 'apply_apply', 2),
            ('apply', 'apply_ipc', 1),
            ('assign', 'assign_assign', 2),
            ('compustat', 'compustat_compustat', 1),
            ('grant', 'grant_cite', 4),
            ('grant', 'grant_grant', 4),
            ('grant', 'grant_ipc', 5),
            ('maint', 'maint_maint', 1),
            ('tmapply', 'tmapply_tmapply', 1),
        ],
    ),
    "concat_parts": (
        "patnum VARCHAR, ipc VARCHAR, rank BIGINT, version VARCHAR",
        [
            ('10000001', 'g06f009/44', 0, '20060101'),
            ('3930584', 'a61b', 1, '2'),
            ('3930584', 'a61b051/2', 0, '2'),
            ('7000001', 'F16H057/04', 1, '07'),
            ('7000001', 'f16h010/0', 0, '07'),
        ],
    ),
    "csv_round_trip": (
        "k BIGINT, t VARCHAR, x DOUBLE",
        [
            (1, 'a\nb', 1.235),
            (2, None, None),
            (3, 'say "x", y', 0.0),
        ],
    ),
    "element_texts": (
        "k BIGINT, own VARCHAR, whole VARCHAR",
        [
            (0, 'plain', 'plain'),
            (1, 'one', 'one |two| three'),
            (2, 'none', 'in|ner'),
            (3, 'none', ''),
            (4, 'none', None),
            (5, 'é&—', 'é&—'),
        ],
    ),
    "simhash_vectors": (
        "name VARCHAR, sig BIGINT",
        [
            ('', -1205034819632174695),
            ('a', -3292477735350538661),
            ('abc', 7349642593840876537),
            ('acme widget', -5254422361071952376),
            ('acme widgets incorporated of boise', 7285884706885983880),
            ('acme widgets', -5252170561258267128),
            ('société générale', 3844602725423577781),
            ('zyx gmbh', -1459191376269197266),
        ],
    ),
    "registered_functions": (
        "raw VARCHAR, number VARCHAR, class VARCHAR, industry VARCHAR, lag INTEGER, weak VARCHAR, strong VARCHAR, kind INTEGER, conveyance INTEGER, state VARCHAR, country VARCHAR, same BOOLEAN",
        [
            ('334', '334', '334', '334000', None, '334', '334', 0, 3, None, None, False),
            ('D0123456789', 'D123456', 'D012345/6789', '000000', None, 'd0123456789', 'd0123456789', 0, 3, None, None, False),
            ('M170', 'M170', 'M170', '000000', 4, 'm170', 'm170', 0, 3, None, None, False),
            ('a61b 512', 'a61', 'a61b051/2', '000000', None, 'a61b 512', 'a61b 512', 0, 3, None, None, False),
            ('acme co., the', 'acme co', 'acme0co/., the', '000000', None, 'acme co the', 'acme', 0, 3, None, None, True),
            ('assignment', 'assignm', 'assignm/ent', '000000', None, 'assignment', 'assignment', 0, 0, None, None, False),
            ('germany', 'germany', 'germany', '000000', None, 'germany', 'germany', 0, 3, None, 'de', True),
            ('john smith', 'john sm', 'john0sm/ith', '000000', None, 'john smith', 'john smith', 2, 3, None, None, False),
            ('state university', 'state u', 'state0u/niversity', '000000', None, 'state university', 'state university', 1, 3, None, None, False),
            ('texas', 'texas', 'texas', '000000', None, 'texas', 'texas', 0, 3, 'tx', None, False),
        ],
    ),
    "long_numbers": (
        "raw VARCHAR, eight VARCHAR, maint VARCHAR",
        [
            ('', '', ''),
            ('0010000001', '1000000', '10000001'),
            ('10000001', '10000001', '10000001'),
            ('RE0350001', 'RE350001', 're350001'),
            ('x1234567890', 'x12345678', 'x1234567890'),
            (None, None, None),
        ],
    ),
    "chosen_sources": (
        "asked VARCHAR, place BIGINT, tag VARCHAR",
        [
            ('all', 0, 'apply'),
            ('all', 1, 'grant'),
            ('all', 2, 'assignor'),
            ('all', 3, 'assignee'),
            ('all', 4, 'compustat'),
            ('both parties', 0, 'assignor'),
            ('both parties', 1, 'assignee'),
            ('default', 0, 'apply'),
            ('default', 1, 'grant'),
            ('default', 2, 'assignor'),
            ('default', 3, 'assignee'),
            ('mixed', 0, 'apply'),
            ('mixed', 1, 'grant'),
            ('mixed', 2, 'assignee'),
            ('one', 0, 'compustat'),
        ],
    ),
    "fetch_archives": (
        "step VARCHAR, listed BIGINT, tried BIGINT, files VARCHAR",
        [
            ('again', 2, 1, 'inner.txt,one.zip'),
            ('dry', 2, 2, ''),
            ('first', 2, 2, 'inner.txt,one.zip'),
            ('overwrite', 2, 2, 'inner.txt,one.zip'),
        ],
    ),
    "panel_from_files": (
        "late INTEGER, names VARCHAR, year BIGINT, age BIGINT, stock BIGINT, n_apply BIGINT, n_grant BIGINT, n_cited BIGINT, n_citing BIGINT, n_self_cited BIGINT, n_source BIGINT, n_dest BIGINT, assets DOUBLE, mktval DOUBLE, naics VARCHAR",
        [
            (0, 'second corp', 1976, 0, 0, 0, 1, 2, 0, 0, 0, 0, None, None, None),
            (0, 'second corp', 2000, 24, 1, 1, 0, 0, 0, 0, 0, 0, None, None, None),
            (0, 'second corp', 2010, 34, 1, 0, 0, 0, 0, 0, 2, 0, None, None, None),
            (0, 'second corporation', 2018, 0, 0, 0, 1, 1, 0, 0, 0, 0, None, None, None),
            (0, 'zyx gmbh', 2010, 0, 0, 0, 0, 0, 0, 0, 0, 2, None, None, None),
            (0, 'zyx gmbh', 2017, 7, 1, 1, 0, 0, 0, 0, 0, 0, None, None, None),
            (0, 'zyx gmbh', 2018, 8, 1, 0, 0, 0, 0, 0, 0, 0, 5.0, 6.0, '334000'),
            (2, 'acme gears ltd', 2006, 0, 0, 0, 1, 1, 0, 0, 0, 0, None, None, None),
            (2, 'second corp', 1976, 0, 0, 0, 1, 2, 0, 0, 0, 0, None, None, None),
            (2, 'second corp', 2000, 24, 1, 1, 0, 0, 0, 0, 0, 0, None, None, None),
            (2, 'second corp', 2010, 34, 1, 0, 0, 0, 0, 0, 2, 0, None, None, None),
            (2, 'second corporation', 2018, 0, 0, 0, 1, 1, 0, 0, 0, 0, None, None, None),
            (2, 'zyx gmbh', 2010, 0, 0, 0, 0, 0, 0, 0, 0, 2, None, None, None),
            (2, 'zyx gmbh', 2017, 7, 1, 1, 0, 0, 0, 0, 0, 0, None, None, None),
            (2, 'zyx gmbh', 2018, 8, 1, 0, 0, 0, 0, 0, 0, 0, 5.0, 6.0, '334000'),
        ],
    ),
}
